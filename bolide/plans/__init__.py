"""How plans are laid out: settled tables, skew-safe ranks, bounded broadcasts."""

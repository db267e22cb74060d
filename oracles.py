"""SQL text that gives each query's result when DuckDB runs it on the same tables.

The text spells out pairs by brute force and the matching by one recursive pass
over the sorted candidates, independent of how the Spark queries get there.
"""

from __future__ import annotations

TWO_PI = "cast(6.283185307179586 as double)"
ONE_PI = "cast(3.141592653589793 as double)"
LIGHT = "cast(299792458 as double)"
ZERO = "cast(0 as double)"
TRACK = ["m_theta", "b_theta", "m_phi", "b_phi", "r_0", "v"]


def away(x: str, digits: int) -> str:
    scale = 10**digits
    return f"(sign({x}) * floor(abs({x}) * {scale} + 0.5) / {scale} + {ZERO})"


def cents(x: str) -> str:
    return f"(sign({x}) * floor(abs({x}) * 100 + 0.5) + {ZERO})"


def th(x: str) -> str:
    return cents(f"(({x}) % {TWO_PI})")


def ph(x: str) -> str:
    return cents(f"(({x}) % {ONE_PI})")


ROCKS = """rocks as (
select s_suppkey as id, s_name as name, 1 + s_suppkey % 9 as mass,
 case when s_suppkey % 5 = 0 then null else concat('nation ', cast(s_nationkey as varchar(10))) end as target,
 cast(s_suppkey % 60 as double) as fired_s,
 cast(s_suppkey % 3 as double) / 100 as m_theta, cast(0.1 as double) + cast(s_suppkey % 8 as double) / 4 as b_theta,
 case when s_suppkey % 7 = 0 then cast(0.01 as double) else cast(0 as double) end as m_phi,
 cast(0.1 as double) + cast(s_suppkey % 4 as double) * 3 / 4 as b_phi,
 cast(1000 + (s_suppkey * 37) % 1000 as double) as r_0, cast(0 - (s_suppkey % 5) as double) as v
from supplier)"""

SLUGS = """slugs as (
select c_custkey as id, c_name as name, case when c_custkey % 4 = 0 then null else c_mktsegment end as target,
 cast(c_custkey % 600 as double) as fired_s,
 cast(0.1 as double) + cast(c_custkey * 7 % 8 as double) / 4 as theta,
 cast(0.1 as double) + floor(cast(c_custkey % 32 as double) / 8) * 3 / 4 as phi,
 cast(1 + c_custkey % 20 as double) as v
from customer)"""

OBS = """observations as (
select r.id as rock_id, r.name, r.fired_s, k.k as obs_no, r.fired_s + 10 + 5 * k.k as obs_s,
 r.r_0 + r.v * (10 + 5 * k.k) as pos_r, r.m_theta * (10 + 5 * k.k) + r.b_theta as pos_theta,
 r.m_phi * (10 + 5 * k.k) + r.b_phi as pos_phi
from rocks r cross join (select 0 as k union all select 1 union all select 2 union all select 3) k)"""

REQUESTS = """requests as (
select event_id, ts, user_id as client,
 case when event_type = 'click' then null else concat(event_type, ' ', cast(event_id as varchar(20))) end as name,
 case when event_type = 'error' then 'abc' else cast(cast(floor(value) as bigint) as varchar(20)) end as theta_txt,
 cast(regexp_extract(props, '[0-9]+', 0) as int) * 10 - 100 as fire_offset_s
from events)"""

CHANGES = """changes as (
select o_custkey as obj_id, o_orderdate as changed_at, o_orderkey as seq, o_orderstatus as status,
 o_totalprice as amount from orders)"""

NEW_SLUG = """new_slug as (select cast(1000000 as bigint) as id, 'new slug' as name, cast(null as varchar) as target,
 cast(0 as double) as fired_s, cast(0.1 as double) as theta, cast(0.1 as double) as phi, cast(50 as double) as v)"""
NEW_ROCK = """new_rock as (select cast(1000000 as bigint) as id, 'new rock' as name, cast(4 as bigint) as mass,
 cast(null as varchar) as target, cast(0 as double) as fired_s, cast(0 as double) as m_theta,
 cast(0.1 as double) as b_theta, cast(0 as double) as m_phi, cast(0.1 as double) as b_phi,
 cast(500 as double) as r_0, cast(0 as double) as v)"""


def verdicts(name: str, rocks: str = "rocks", slugs: str = "slugs") -> str:
    """Every pair of two relations with its full verdict."""
    return f"""{name}_t as (
select r.id as rock, s.id as slug, r.fired_s as rf, s.fired_s as sf, r.m_theta, r.b_theta, r.m_phi, r.b_phi, r.r_0,
 r.v as rv, s.theta, s.phi, s.v as sv,
 case when s.v <> r.v then s.fired_s + (r.r_0 + r.v * (s.fired_s - r.fired_s)) / (s.v - r.v) end as t
from {rocks} r cross join {slugs} s),
{name}_b as (
select rock, slug, t, coalesce(t >= rf and t >= sf, false) as flying,
 {away("(r_0 + rv * (t - rf))", 2)} as rr, {away("(sv * (t - sf))", 2)} as sr,
 {th("m_theta * (t - rf) + b_theta")} as rth, {th("theta")} as sth,
 {ph("m_phi * (t - rf) + b_phi")} as rph, {ph("phi")} as sph
from {name}_t),
{name} as (
select rock, slug, t, case when flying then sr end as pos_r, case when flying then sth / 100 end as pos_theta,
 case when flying then sph / 100 end as pos_phi, case when flying then {away("(rr - sr)", 2)} end as mdiff_r,
 case when flying then (rth - sth) / 100 end as mdiff_theta, case when flying then (rph - sph) / 100 end as mdiff_phi,
 case when not flying then 'r' when rth <> sth and rph <> sph then 'theta,phi' when rth <> sth then 'theta'
  when rph <> sph then 'phi' end as miss
from {name}_b)"""


def candidates(name: str, rocks: str = "rocks", slugs: str = "slugs") -> str:
    return (
        verdicts(f"{name}_v", rocks, slugs)
        + f",\n{name} as materialized (select * from {name}_v where miss is null)"
    )


def matched(name: str, cands: str) -> str:
    """One recursive pass over candidates in order, with lists of used objects."""
    taken = f"list_contains({name}_g.rs, e.rock) or list_contains({name}_g.ss, e.slug)"
    return f"""{name}_e as materialized (
select *, row_number() over (order by t, rock, slug) as i from {cands}),
{name}_g as (
select cast(0 as bigint) as i, []::bigint[] as rs, []::bigint[] as ss, false as ok
union all
select e.i, case when {taken} then {name}_g.rs else list_append({name}_g.rs, e.rock) end,
 case when {taken} then {name}_g.ss else list_append({name}_g.ss, e.slug) end, not ({taken})
from {name}_g join {name}_e e on e.i = {name}_g.i + 1),
{name} as materialized (select e.* exclude (i, miss) from {name}_g g join {name}_e e using (i) where g.ok)"""


def firsts(name: str, cands: str) -> str:
    return f"""{name} as materialized (select rock, slug, t from (
select rock, slug, t, row_number() over (partition by rock order by t, slug) as k from {cands}) where k = 1)"""


def sql(*ctes: str, then: str) -> str:
    return "with recursive " + ",\n".join(ctes) + "\n" + then


BASE = [ROCKS, SLUGS]
CANDS = [*BASE, candidates("candidates")]
HITS = [*CANDS, matched("hits", "candidates")]
FIRSTS = [*CANDS, firsts("firsts", "candidates")]

HIT_COLUMNS = ["pos_r", "pos_theta", "pos_phi", "mdiff_r", "mdiff_theta", "mdiff_phi"]


def octant(x: str, y: str, z: str) -> str:
    return f"""case when {x} >= 0 and {y} >= 0 and {z} >= 0 then 1 when {x} < 0 and {y} >= 0 and {z} >= 0 then 2
 when {x} < 0 and {y} < 0 and {z} >= 0 then 3 when {x} >= 0 and {y} < 0 and {z} >= 0 then 4
 when {x} >= 0 and {y} >= 0 and {z} < 0 then 5 when {x} < 0 and {y} >= 0 and {z} < 0 then 6
 when {x} < 0 and {y} < 0 and {z} < 0 then 7 when {x} >= 0 and {y} < 0 and {z} < 0 then 8 end"""


def _sighting(name: str, source: str, r: str, theta: str, phi: str, keep: str, side: str, at: float) -> str:
    """CTEs for positions of one relation at a time, with its hits joined."""
    T = f"cast({at} as double)"
    hit_cols = ", ".join(f"h.{c} as collision_{c}" for c in HIT_COLUMNS)
    return f"""{name}_1 as (select *, {T} - fired_s as age from {source}),
{name}_2 as (select *, age - ({r}) / {LIGHT} as late from {name}_1),
{name}_3 as (select *, {r} as pos_r, {theta} as pos_theta, {phi} as pos_phi,
 {r.replace("age", "late")} as d_r, {theta.replace("age", "late")} as d_theta, {phi.replace("age", "late")} as d_phi
 from {name}_2),
{name}_4 as (select *, pos_r * sin(pos_phi) * cos(pos_theta) as x, pos_r * sin(pos_phi) * sin(pos_theta) as y,
 pos_r * cos(pos_phi) as z, d_r * sin(d_phi) * cos(d_theta) as dx, d_r * sin(d_phi) * sin(d_theta) as dy,
 d_r * cos(d_phi) as dz from {name}_3),
{name} as (select o.id, o.name, o.target, {keep}, h.t as collided_s, {hit_cols},
 o.pos_r, o.pos_theta, o.pos_phi, {away("d_r", 6)} as delay_pos_r, {away("d_theta", 6)} as delay_pos_theta,
 {away("d_phi", 6)} as delay_pos_phi, {away("x", 6)} as cpos_x, {away("y", 6)} as cpos_y, {away("z", 6)} as cpos_z,
 {away("dx", 6)} as delay_cpos_x, {away("dy", 6)} as delay_cpos_y, {away("dz", 6)} as delay_cpos_z,
 {octant("x", "y", "z")} as octant, {octant("dx", "dy", "dz")} as delay_octant, {T} as t, age as age_s
from {name}_4 o left join hits h on o.id = h.{side})"""


def rocks_at(name: str = "rocks_at", at: float = 300, rocks: str = "rocks") -> str:
    keep = "o.mass, o.fired_s, " + ", ".join(f"o.{c}" for c in TRACK)
    return _sighting(
        name, rocks, "r_0 + v * age", "m_theta * age + b_theta", "m_phi * age + b_phi", keep, "rock", at
    )


def slugs_at(name: str = "slugs_at", at: float = 300) -> str:
    keep = "o.fired_s, o.theta, o.phi, o.v"
    return _sighting(name, "slugs", "v * age", "theta", "phi", keep, "slug", at)


SEEN = (
    ["id", "name", "target", "mass", "fired_s", "collided_s"]
    + [f"collision_{c}" for c in HIT_COLUMNS]
    + ["pos_r", "pos_theta", "pos_phi", "delay_pos_r", "delay_pos_theta", "delay_pos_phi"]
    + [f"{p}cpos_{c}" for p in ("", "delay_") for c in "xyz"]
    + ["octant", "delay_octant", "t", "age_s"]
)


def all_objects(name: str = "all_objects", at: float = 300, rocks: str = "rocks") -> list[str]:
    seen = ", ".join(SEEN)
    s_seen = ", ".join("cast(1 as bigint) as mass" if c == "mass" else c for c in SEEN)
    r_params = ", ".join(f"{c} as rock_params_{c}" for c in TRACK)
    no_r = ", ".join(f"cast(null as double) as rock_params_{c}" for c in TRACK)
    s_params = ", ".join(f"{c} as slug_params_{c}" for c in ("theta", "phi", "v"))
    no_s = ", ".join(f"cast(null as double) as slug_params_{c}" for c in ("theta", "phi", "v"))
    return [
        rocks_at(f"{name}_r", at, rocks),
        slugs_at(f"{name}_s", at),
        f"""{name} as (select 'rock' as type, {seen}, {r_params}, {no_s} from {name}_r
union all select 'slug' as type, {s_seen}, {no_r}, {s_params} from {name}_s)""",
    ]


def active(name: str = "active", at: float = 300, rocks: str = "rocks") -> list[str]:
    T = f"cast({at} as double)"
    return [
        *all_objects(f"{name}_all", at, rocks),
        f"""{name} as (select * from {name}_all where fired_s <= {T}
 and (collided_s is null or collided_s > {T}) and pos_r >= 0)""",
    ]


ACTIVE = [*HITS, *active()]
TELESCOPE = """id, type, name, target, mass, fired_s, pos_r, pos_theta, pos_phi, cpos_x, cpos_y, cpos_z,
 t as obs_s, octant, floor(age_s) % 86400 as age"""

IMPACTS = """impacts as (
select r.id, r.name as rock, r.target, r.fired_s, r.t,
 case when arrives then r_0 + v * (t - fired_s) end as pos_r,
 case when arrives then m_theta * (t - fired_s) + b_theta end as pos_theta,
 case when arrives then m_phi * (t - fired_s) + b_phi end as pos_phi,
 case when not arrives then 'r' end as miss
from (select *, coalesce(t >= fired_s, false) as arrives from
 (select *, case when v <> 0 then fired_s + r_0 / (-v) end as t from rocks)) r
where r.id not in (select rock from hits) and r.t <= 600)"""


def roman(n: str) -> str:
    """Subtractive numerals by counting down the table of values."""
    parts = []
    values = [
        (1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"),
        (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"),
    ]
    rest = f"cast({n} as bigint)"
    for value, text in values:
        parts.append(f"repeat('{text}', {rest} // {value})")
        rest = f"({rest} % {value})"
    return "(" + " || ".join(parts) + ")"


def cascade(rule: str) -> list[str]:
    """Hits one at a time in order, each adding its fragment to the objects in play."""
    if rule == "reference":
        b_theta = "n.b_theta + n.m_theta / 2 * n.t"
        b_phi = "n.b_phi + n.b_phi / 2 * n.t"
    else:
        b_theta = "n.m_theta * (n.t - n.fired_s) + n.b_theta"
        b_phi = "n.m_phi * (n.t - n.fired_s) + n.b_phi"
    kind = """struct(id bigint, root bigint, gen bigint, mass bigint, fired_s double, m_theta double,
 b_theta double, m_phi double, b_phi double, r_0 double, v double)[]"""
    fields = ["id", "root", "gen", "mass", "fired_s", "m_theta", "b_theta", "m_phi", "b_phi", "r_0", "v"]
    opened = ", ".join(f"x.{c} as {c}" for c in fields)
    own = ", ".join(f"f.{c}" for c in fields)
    return [
        *CANDS,
        """cands as materialized (select r.id, r.id as root, cast(0 as bigint) as gen, r.mass, r.fired_s, r.m_theta,
 r.b_theta, r.m_phi, r.b_phi, r.r_0, r.v, c.slug, c.t, c.pos_r from candidates c join rocks r on c.rock = r.id)""",
        "shots as materialized (select * from slugs)",
        f"""g as (
select cast(0 as bigint) as i, []::bigint[] as rs, []::bigint[] as ss, []::{kind} as fr,
 cast(null as bigint) as rock, cast(null as bigint) as slug, cast(null as double) as t
union all
select g.i + 1, list_append(g.rs, n.id), list_append(g.ss, n.slug),
 case when n.mass > 1 then list_append(g.fr, {{'id': n.root + (n.gen + 1) * 1000000000000, 'root': n.root,
  'gen': n.gen + 1, 'mass': n.mass // 2, 'fired_s': n.t, 'm_theta': n.m_theta / 2, 'b_theta': {b_theta},
  'm_phi': n.m_phi / 2, 'b_phi': {b_phi}, 'r_0': n.pos_r + 1, 'v': n.v}}) else g.fr end,
 n.id, n.slug, n.t
from g, lateral (select * from (
  select {", ".join(fields)}, slug, t, pos_r from cands
  where not list_contains(g.rs, cands.id) and not list_contains(g.ss, cands.slug)
  union all
  select {", ".join(fields)}, slug, t, {away("(sv * (t - sf))", 2)} as pos_r
  from (select {own}, s.id as slug, s.fired_s as sf, s.v as sv, s.theta, s.phi,
    case when s.v <> f.v then s.fired_s + (f.r_0 + f.v * (s.fired_s - f.fired_s)) / (s.v - f.v) end as t
   from (select {opened} from (select unnest(g.fr) as x)) f, shots s
   where not list_contains(g.rs, f.id) and not list_contains(g.ss, s.id)) y
  where t >= fired_s and t >= sf
   and {th("m_theta * (t - fired_s) + b_theta")} = {th("theta")}
   and {ph("m_phi * (t - fired_s) + b_phi")} = {ph("phi")}
 ) order by t, id, slug limit 1) n)""",
        f"""fragments as (select {own}, r.name as root_name from
 (select {opened} from (select unnest(fr) as x from g where i = (select max(i) from g))) f
 join rocks r on f.root = r.id)""",
    ]


def world() -> list[str]:
    """Rocks with all fragments, and the hits of the cascade."""
    none = ", ".join(f"cast(null as double) as {c}" for c in HIT_COLUMNS)
    rest = ", ".join(["mass", "target", "fired_s", *TRACK])
    born = rest.replace("target", "cast(null as varchar)")
    return [
        *cascade("continuous"),
        f"""world as materialized (select id, name, {rest} from rocks union all
 select id, root_name || ' ' || {roman("gen")} as name, {born} from fragments)""",
        f"hits as (select rock, slug, t, {none} from g where rock is not null)",
    ]


def timed_requests() -> list[str]:
    """Requests with clock text, the launch read from it, and the reason for rejection."""
    return [
        REQUESTS,
        """clocked as (select *, case when event_id % 5 = 0 then null when event_id % 7 = 0 then 'not a time'
 else strftime(ts + to_seconds(fire_offset_s), '%H:%M:%S') end as fired,
 row_number() over (partition by name is null order by ts, event_id) * 10 as shot from requests)""",
        """launches as (select *, try_strptime(strftime(ts, '%Y-%m-%d') || ' ' || fired, '%Y-%m-%d %H:%M:%S') as launch
 from clocked)""",
        """timed as (select event_id, ts, launch, fired, coalesce(name, 'shot #' || cast(shot as varchar)) as name,
 try_cast(theta_txt as double) as theta, case when try_cast(theta_txt as double) is null then 'bad angle'
 when fired is not null and launch is null then 'bad firing time'
 when launch < ts then 'in the past' when launch > ts + to_seconds(300) then 'too far ahead' end as reject_reason
 from launches)""",
    ]


def pieces() -> list[str]:
    """Static breakup by recursion over levels."""
    half = ONE_PI + " / 4"
    out = "orig_name || ' ' || "
    names = f"{out}{roman('idx')}", f"{out}{roman('(idx + 1)')}"
    sides = []
    for shift, sign, name in ((0, "+", names[0]), (1, "-", names[1])):
        sides.append(f"""select rock * 128 + idx + {shift} as id, {name} as name, cast(1 as bigint) as mass, t as fired_s,
 m_theta * m_factor as m_theta, b_theta {sign} nudge as b_theta, m_phi * m_factor as m_phi,
 b_phi {sign} nudge as b_phi, hit_r as r_0, v from levels""")
    return [
        *FIRSTS,
        f"""levels as (
select cast(1 as bigint) as idx, r.mass // 2 as mass_left, r.name as orig_name, f.t, cast(2 as bigint) as m_factor,
 {half} as nudge, c.pos_r as hit_r, r.v, r.m_theta, r.b_theta, r.m_phi, r.b_phi, r.id as rock
from firsts f join rocks r on f.rock = r.id join candidates c on c.rock = f.rock and c.slug = f.slug
union all
select idx + 2, mass_left // 2, orig_name, t, m_factor // 2, nudge * 2, hit_r, v, m_theta, b_theta, m_phi, b_phi, rock
from levels where mass_left > 1)""",
        "pieces as materialized (" + "\nunion\n".join(sides) + ")",
    ]


def _params(name, r, s) -> str:
    """Rock and slug parameters scaled by 1.2345 and passed through a function."""
    k = "cast(1.2345 as double)"
    rock = ", ".join(f"{r(c, f'({c} * {k})')} as {c}" for c in TRACK)
    none = ", ".join(f"cast(null as double) as {c}" for c in TRACK if c != "v")
    slug = ", ".join(f"{s(c, f'({c} * {k})')} as {c}" for c in ("v", "theta", "phi"))
    return f"""select 'rock' as type, id, {rock}, cast(null as double) as theta, cast(null as double) as phi from rocks
union all select 'slug' as type, id, {none}, {slug} from slugs"""


def _wrapped(c: str, x: str) -> str:
    if c in ("b_theta", "theta"):
        return f"{x} % {TWO_PI}"
    if c in ("b_phi", "phi"):
        return f"{x} % {ONE_PI}"
    return x


def _fit() -> str:
    t0, t1 = "(a_s - fired_s)", "(b_s - fired_s)"

    def line(y: str, slope: str, cut: str) -> str:
        m = f"((a_{y} - b_{y}) / ({t0} - {t1}))"
        return f"{m} as {slope}, a_{y} - {m} * {t0} as {cut}, b_{y} - {m} * {t1} as {cut}_check"

    return f"""pairs as (
select name, fired_s, (n - 1) // 2 as pair_no, min(obs_s) as a_s, max(obs_s) as b_s,
 arg_min(pos_r, n) as a_r, arg_max(pos_r, n) as b_r, arg_min(pos_theta, n) as a_th, arg_max(pos_theta, n) as b_th,
 arg_min(pos_phi, n) as a_ph, arg_max(pos_phi, n) as b_ph
from (select *, row_number() over (partition by name, fired_s order by obs_s, obs_no) as n from observations)
group by name, fired_s, (n - 1) // 2 having count(*) = 2),
fits as (select name, fired_s, pair_no, b_s as last_obs_s, {line("r", "v", "r_0")},
 {line("th", "m_theta", "b_theta")}, {line("ph", "m_phi", "b_phi")} from pairs)"""


def _close(a: str, b: str) -> str:
    return f"abs({a} - {b}) <= 1e-9 * greatest(abs({a}), abs({b}))"


def _diff(op: str, late: bool) -> str:
    extra = " and fired_s >= 300" if late else ""
    sped = f"""slugs2 as (select id, name, target, fired_s, theta, phi,
 case when id % 10 = 0{extra} then v * 10 else v end as v from slugs)"""
    one, two = ("hits", "hits2") if op == "retract" else ("hits2", "hits")
    return sql(
        *HITS, sped, candidates("candidates2", "rocks", "slugs2"), matched("hits2", "candidates2"),
        then=f"select rock, slug, t from {one} except select rock, slug, t from {two}",
    )


def _whatif(rocks: str, slugs: str, *extra: str) -> str:
    return sql(
        *BASE, *extra, candidates("candidates", rocks, slugs), firsts("firsts", "candidates"),
        then="""select slug, rock, t from (select *, row_number() over (partition by slug order by t, rock) as k
from firsts) where k = 1""",
    )


RANKS = """ranks as (
select rock, slug, t, count(*) over (partition by slug) as slug_count, count(*) over (partition by rock) as rock_count,
 row_number() over (partition by slug order by t, rock, slug) as slug_rank,
 row_number() over (partition by rock order by t, rock, slug) as rock_rank from candidates)"""


def oracle_sql() -> dict[str, str]:
    hit = "rock, slug, t"
    verdict = "rock, slug, t, pos_r, pos_theta, pos_phi, mdiff_r, mdiff_theta, mdiff_phi, miss"
    at = "(cast(300.125 as double) - fired_s)"
    late = "(cast(600 as double) - fired_s)"
    before, after = "(cast(-300 as double) - fired_s)", "(cast(300 as double) - fired_s)"
    of_slug = [*BASE, NEW_SLUG, verdicts("of_slug", "rocks", "new_slug")]
    of_rock = [NEW_ROCK, verdicts("of_rock", "new_rock", "slugs")]
    frag_params = "id, root_name || ' ' || {} as name, mass, fired_s, m_theta, b_theta, m_phi, b_phi, r_0, v"
    family = """family as (select name, name as root_name, id from rocks
union all select root_name || ' ' || {} as name, root_name, id from fragments)""".format(roman("gen"))
    solution = f"""solutions as (select *, last_obs_s + 5 as launch_s,
 (v * fired_s - r_0 - 25 * (last_obs_s + 5)) / (v - 25) as t_collide from fits)"""
    rounds = ["300", "600", "1500", "100000"]
    clear = [*HITS]
    for i, r in enumerate(rounds):
        clear += active(f"active{i}", float(r))
    out = {
        "scan_rocks": sql(ROCKS, then="select * from rocks"),
        "scan_slugs": sql(SLUGS, then="select * from slugs"),
        "rounded_positions": sql(
            ROCKS,
            then=f"""select id, {away(f"(r_0 + v * {at})", 2)} as pos_r,
 {away(f"(m_theta * {at} + b_theta)", 2)} as pos_theta, {away(f"(m_phi * {at} + b_phi)", 2)} as pos_phi from rocks""",
        ),
        "rounded_params": sql(
            *BASE, then=_params("r", lambda c, x: away(x, 2), lambda c, x: away(x, 2))
        ),
        "normalized_params": sql(*BASE, then=_params("n", _wrapped, _wrapped)),
        "normalized_positions": sql(
            ROCKS,
            then=f"""select id, r_0 + v * {before} as r_before, (m_theta * {before} + b_theta) % {TWO_PI} as theta_before,
 (m_phi * {before} + b_phi) % {ONE_PI} as phi_before, (m_theta * {after} + b_theta) % {TWO_PI} as theta_after,
 (m_phi * {after} + b_phi) % {ONE_PI} as phi_after from rocks""",
        ),
        "to_cartesian": sql(
            ROCKS,
            f"""p as (select id, r_0 + v * {after} as r, m_theta * {after} + b_theta as th,
 m_phi * {after} + b_phi as ph from rocks)""",
            then=f"""select id, {away("(r * sin(ph) * cos(th))", 6)} as x, {away("(r * sin(ph) * sin(th))", 6)} as y,
 {away("(r * cos(ph))", 6)} as z from p""",
        ),
        "to_spherical": sql(
            SLUGS,
            f"""p as (select id, v * {late} * sin(phi) * cos(theta) as x, v * {late} * sin(phi) * sin(theta) as y,
 v * {late} * cos(phi) as z from slugs)""",
            "q as (select *, sqrt(x * x + y * y + z * z) as r0 from p)",
            then=f"""select id, {away("r0", 6)} as r, {away("atan2(y, x)", 6)} as theta,
 {away("acos(z / r0)", 6)} as phi from q""",
        ),
        "delayed_positions": sql(
            ROCKS,
            f"""p as (select id, v, m_theta, b_theta, m_phi, b_phi, r_0 * {LIGHT} / 100 as r1,
 cast(300 as double) - fired_s as age from rocks)""",
            f"q as (select *, age - (r1 + v * age) / {LIGHT} as late from p)",
            then=f"""select id, {away("(r1 + v * late)", 6)} as r, {away("(m_theta * late + b_theta)", 6)} as theta,
 {away("(m_phi * late + b_phi)", 6)} as phi from q""",
        ),
        "params_from_impact": sql(
            ROCKS,
            f"p as (select id, r_0 / 10 + 1 as t_impact, {LIGHT} / 2 as speed from rocks)",
            then="""select id, t_impact, -speed as v, speed * t_impact as r_0,
 -(speed * t_impact) / (-speed) as impact_age from p""",
        ),
        "roman_names": f"""select p_partkey as id, p_name || ' ' || {roman("(p_partkey % 3999 + 1)")} as name,
 cast(p_size // 2 as bigint) as half_size from part""",
        "launch_timestamps": sql(
            SLUGS,
            """p as (select id, fired_s * cast(1000.5 as double) as s from slugs)""",
            """q as (select id, s, timestamp '2024-01-01 00:00:00' + to_microseconds(cast(floor(s * 1000000 + 0.5) as bigint))
 as f from p)""",
            then="""select id, strftime(f, '%Y-%m-%d %H:%M:%S.%g') as fired,
 floor(s * 1000000 + 0.5) / 1000000 as back_s, (floor(s * 1000000 + 0.5) / 1000000) % 86400 as of_day_s,
 strftime(date_trunc('day', f), '%Y-%m-%d') as day from q""",
        ),
        "short_names": """with w as (select p_partkey as id, trim(p_name) as n, string_split_regex(trim(p_name), '\\s+') as ws
 from part),
d as (select *, md5(n) as h from w),
k as (select *, 2 + cast(('0x' || substr(h, 1, 2)) as int) % 7 as len,
 list_filter(ws[1:-2], lambda x: regexp_matches(x, '^\\p{L}')) as fore from d)
select id, trim(array_to_string(list_transform(fore, lambda x: substr(x, 1, 1)), '') || ' ' || ws[-1] || ' '
 || substr(translate(h, 'abcdef', '012345'), 3, len)) as short from k""",
        "collisions_of_slug": sql(*of_slug, then=f"select {verdict} from of_slug"),
        "collisions_of_rock": sql(*BASE, *of_rock, then=f"select {verdict} from of_rock"),
        "miss_reason_counts": sql(
            *of_slug, *of_rock,
            then="""select 'slug' as "of", coalesce(miss, 'hit') as reason, count(*) as n from of_slug group by 2
union all select 'rock' as "of", coalesce(miss, 'hit') as reason, count(*) as n from of_rock group by 2""",
        ),
        "collisions_named": sql(
            *of_slug, *of_rock,
            then="""select r.name as rock_name, s.name as slug_name, c.miss, c.t
from (select * from of_slug union all select * from of_rock) c
join (select id, name from rocks union all select id, name from new_rock) r on c.rock = r.id
join (select id, name from slugs union all select id, name from new_slug) s on c.slug = s.id""",
        ),
        "candidate_hits": sql(*CANDS, then=f"select {hit} from candidates"),
        "ordered_matching": sql(*HITS, then=f"select {hit} from hits"),
        "hits_named": sql(
            *HITS,
            then="""select r.name as rock_name, s.name as slug_name, h.t, h.pos_r, h.pos_theta, h.pos_phi from hits h
join rocks r on h.rock = r.id join slugs s on h.slug = s.id""",
        ),
        "first_hit_per_rock": sql(*FIRSTS, then=f"select {hit} from firsts"),
        "first_rock_per_slug": sql(
            *FIRSTS,
            then="""select slug, rock, t from (select *, row_number() over (partition by slug order by rock, t) as k
from firsts) where k = 1""",
        ),
        "first_rock_per_slug_distinct_on": sql(
            *FIRSTS,
            then="select distinct on (slug) slug, rock, t from firsts order by slug, t, rock",
        ),
        "contention_counts": sql(
            *CANDS, RANKS, then="select rock, slug, t, slug_count, rock_count from ranks"
        ),
        "contention_ranks": sql(
            *CANDS, RANKS, then="select rock, slug, t, slug_rank, rock_rank from ranks"
        ),
        "mutual_first": sql(
            *CANDS, RANKS,
            then="""select rock, slug, t, slug_rank, rock_rank, slug_count, rock_count from ranks where
 (slug_count = 1 and rock_count = 1) or (slug_count = 1 and rock_count > 1 and rock_rank = 1)
 or (rock_count = 1 and slug_count > 1 and slug_rank = 1)
 or (rock_count > 1 and slug_count > 1 and slug_rank = rock_rank)""",
        ),
        "struct_any_not_null": sql(*FIRSTS, then=f"select {hit} from firsts"),
        "what_if_slug": _whatif(
            "rocks", "slugs2", NEW_SLUG,
            "slugs2 as (select * from slugs where id <> 1000000 union all select * from new_slug)",
        ),
        "what_if_rock": _whatif(
            "rocks2", "slugs", NEW_ROCK,
            "rocks2 as (select * from rocks where id <> 1000000 union all select * from new_rock)",
        ),
        "what_if_pair": sql(
            *FIRSTS,
            "together as (select * from firsts union select 1, 1, cast(1 as double))",
            then="""select rock, slug, t from (select *, row_number() over (partition by rock order by t, slug) as k
from together) where k = 1""",
        ),
        "hits_retracted": _diff("retract", False),
        "hits_added": _diff("add", False),
        "hits_retracted_late": _diff("retract", True),
        "hits_added_late": _diff("add", True),
        "first_generation_fragments": sql(
            *HITS,
            then="""select r.id + 1000000000000 as id, r.name || ' I' as name, r.mass // 2 as mass, h.t as fired_s,
 r.m_theta / 2 as m_theta, r.b_theta + r.m_theta / 2 * h.t as b_theta, r.m_phi / 2 as m_phi,
 r.b_phi + r.b_phi / 2 * h.t as b_phi, h.pos_r + 1 as r_0, r.v, r.name as root_name
from hits h join rocks r on h.rock = r.id where r.mass > 1""",
        ),
        "family_sizes": sql(
            *cascade("continuous"), family,
            then="select root_name, count(*) as members from family group by root_name",
        ),
        "family_by_prefix": sql(
            *cascade("continuous"), family,
            then="select id, name from family where name like 'Supplier#00000000%'",
        ),
        "static_fragments": sql(*pieces(), then="select * exclude (id) from pieces"),
        "fragment_collisions": sql(
            *pieces(), candidates("met", "pieces", "slugs"), firsts("met1", "met"),
            then=f"select rock as fragment, slug, {away('t', 6)} as t from met1",
        ),
        "fragment_collisions_aimed": sql(
            *pieces(),
            "aimed as materialized (select id, name, fired_s, b_theta as theta, b_phi as phi,"
            " cast(20 + id % 7 as double) as v from pieces)",
            candidates("hit", "pieces", "aimed"), firsts("hit1", "hit"),
            then=f"select rock as fragment, slug, {away('t', 6)} as t from hit1",
        ),
        "rocks_at": sql(*HITS, rocks_at(), then="select * from rocks_at"),
        "slugs_at": sql(*HITS, slugs_at(), then="select * from slugs_at"),
        "all_objects": sql(*HITS, *all_objects(), then="select * from all_objects"),
        "active_objects": sql(*ACTIVE, then="select type, id, pos_r, octant, collided_s from active"),
        "observe_octant": sql(*ACTIVE, then=f"select {TELESCOPE} from active where octant = 1"),
        "sky_scan": sql(*ACTIVE, then=f"select {TELESCOPE} from active where octant is not null"),
        "octant_histogram": sql(
            *ACTIVE, then="select octant, type, count(*) as n from active group by octant, type"
        ),
        "lookup_object": sql(
            *ACTIVE, then="select type, id, name, pos_r from active where type = 'slug' and id = 77"
        ),
        "observations_json_fields": sql(
            *ACTIVE,
            then="""select id, type, name, mass,
 strftime(timestamp '2024-01-01 00:00:00' + to_microseconds(cast(floor(fired_s * 1000000 + 0.5) as bigint)),
  '%Y-%m-%dT%H:%M:%S.%f') || 'Z' as fired, pos_r, '2024-01-01T00:05:00.000000Z' as obs_time, octant,
 cast(floor(age_s) % 86400 as bigint) as age from active where octant is not null""",
        ),
        "impacts": sql(*HITS, IMPACTS, then="select * from impacts"),
        "impact_report": sql(
            *HITS, IMPACTS,
            """w as (select *, timestamp '2024-01-01 00:00:00'
 + to_microseconds(cast(floor(t * 1000000 + 0.5) as bigint)) as moment from impacts)""",
            then="""select substr(rock, 1, 20) as rock, substr(target, 1, 15) as target,
 strftime(moment, '%H:%M:%S') as clock, strftime(moment, '%Y-%m-%d') as day, 'vaporized' as status from w""",
        ),
        "hits_of_live_rocks": sql(
            *ACTIVE,
            then=f"select {hit} from hits where rock in (select id from active where type = 'rock')",
        ),
        "eta_signed": sql(
            *ACTIVE,
            then="""select id, name, coalesce(target, 'unknown') as target, type,
 case when rock_params_v <> 0 then pos_r / rock_params_v end as eta, rock_params_v = 0 as never
from active where type = 'rock'""",
        ),
        "time_to_impact": sql(
            *ACTIVE,
            then="""select id, case when rock_params_v < 0 then pos_r / (-rock_params_v) end as time_to_impact,
 not (rock_params_v < 0) as never from active where type = 'rock'""",
        ),
        "top_oldest_rocks": sql(
            *ACTIVE,
            then="""select id, name, pos_r as distance,
 case when rock_params_v < 0 then pos_r / (-rock_params_v) end as time_to_impact, age_s,
 age_s % 86400 as age_of_day_s, coalesce(target, '?') as target, not (rock_params_v < 0) as never
from active where type = 'rock' order by age_s desc, id limit 5""",
        ),
        "top_newest_slugs": sql(
            *ACTIVE,
            then="""select id, name, pos_r as distance, age_s, age_s % 86400 as age_of_day_s,
 coalesce(target, '?') as target from active where type = 'slug' order by age_s, id limit 5""",
        ),
        "all_clear_rounds": sql(
            *clear,
            then="\nunion all ".join(
                f"""select cast({r} as double) as round_s, count(*) as rocks, count(*) = 0 as all_clear
from active{i} where type = 'rock'""" for i, r in enumerate(rounds)
            ),
        ),
        "last_position": sql(
            ROCKS, OBS,
            then="""select name, pos_r, pos_theta, pos_phi from (select *, row_number() over
 (partition by name order by obs_s desc, obs_no desc) as k from observations) where k = 1""",
        ),
        "two_point_fit": sql(
            ROCKS, OBS, _fit(),
            then="select name, fired_s, pair_no, last_obs_s, "
            + ", ".join(f"{away(c, 6)} as {c}" for c in ("v", "r_0", *TRACK[:4]))
            + f""", {_close("r_0", "r_0_check")} and {_close("b_theta", "b_theta_check")}
 and {_close("b_phi", "b_phi_check")} as consistent from fits""",
        ),
        "firing_solutions": sql(
            ROCKS, OBS, _fit(), solution,
            then=f"""select name, fired_s, pair_no, launch_s, {away("t_collide", 6)} as t_collide,
 {away("(v * (t_collide - fired_s) + r_0)", 6)} as r_collide,
 {away("(m_theta * (t_collide - fired_s) + b_theta)", 6)} as theta,
 {away("(m_phi * (t_collide - fired_s) + b_phi)", 6)} as phi from solutions""",
        ),
        "sample_trajectory": sql(
            ROCKS,
            "grid as (select cast(k as double) as age_s from range(0, 1001, 50) r(k))",
            "s as (select r.*, g.age_s, r_0 + v * g.age_s as raw from rocks r cross join grid g)",
            "stops as (select id, min(age_s) as stop from s where raw < 1 group by id)",
            "h as (select s.*, case when raw < 1 then stop else age_s end as held from s left join stops using (id))",
            then=f"""select id, age_s, greatest(raw, {ZERO}) as pos_r, m_theta * held + b_theta as pos_theta,
 m_phi * held + b_phi as pos_phi from h""",
        ),
        "history_intervals": sql(
            CHANGES,
            then="""select obj_id, seq, status, amount, changed_at as valid_from,
 lead(changed_at) over (partition by obj_id order by changed_at, seq) as valid_to from changes""",
        ),
        "history_as_of": sql(
            CHANGES,
            then="""select obj_id, seq, status, amount from (select *, row_number() over
 (partition by obj_id order by changed_at desc, seq desc) as k from changes
 where changed_at <= timestamp '1997-01-01 00:00:00') where k = 1""",
        ),
        "history_as_of_join": sql(
            CHANGES,
            """probes as (select l_orderkey, l_linenumber, o_custkey as obj_id, l_shipdate from lineitem
 join orders on l_orderkey = o_orderkey)""",
            """latest as (select *, row_number() over (partition by obj_id, changed_at order by seq desc) as k
 from changes)""",
            then="""select l_orderkey, l_linenumber, p.obj_id, seq, status, amount from probes p
asof left join (select * from latest where k = 1) c on p.obj_id = c.obj_id and p.l_shipdate >= c.changed_at""",
        ),
        "field_changes": sql(
            CHANGES,
            then="""select obj_id, seq, old_status, status as new_status from (select *, lag(status) over
 (partition by obj_id order by changed_at, seq) as old_status from changes) where status <> old_status""",
        ),
        "changed_rows": sql(
            SLUGS,
            then="select id, v * 10 as v from slugs where id % 10 = 0",
        ),
        "validate_requests": sql(
            REQUESTS,
            """n as (select *, row_number() over (partition by name is null order by ts, event_id) * 10 as shot
 from requests)""",
            then="""select event_id, client, coalesce(name, 'shot #' || cast(shot as varchar)) as name,
 try_cast(theta_txt as double) as theta, case when try_cast(theta_txt as double) is null then 'bad angle'
 when fire_offset_s < 0 then 'in the past' when fire_offset_s > 300 then 'too far ahead' end as reject_reason from n""",
        ),
        "rate_limit_violations": sql(
            REQUESTS,
            then="""select client, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as window_start,
 count(*) as requests from requests group by client, date_trunc('hour', ts) having count(*) > 1""",
        ),
        "constraint_violations": sql(
            ROCKS,
            then="""select id, 'name' as "column" from rocks where id % 4 = 0
union all select id, 'v' as "column" from rocks where mass = 3""",
        ),
        "matching_invariants": sql(
            *HITS,
            then="""select count(*) as hits, count(distinct rock) as rocks, count(distinct slug) as slugs,
 count(*) = count(distinct rock) and count(*) = count(distinct slug) as ok from hits""",
        ),
        "dangling_references": sql(
            *HITS,
            then=f"select {hit} from hits where rock not in (select id from rocks where m_phi = 0)",
        ),
        "dangling_references_all": sql(
            *HITS,
            "born as (select r.id + 1000000000000 as id, r.m_phi, h.t from hits h join rocks r on h.rock = r.id"
            " where r.mass > 1)",
            then="""select 'rock' as "column", rock as id from hits join rocks on rock = id where m_phi <> 0
union all select 'slug', slug from hits where slug % 10 = 0
union all select 'source_rock', id from born where m_phi <> 0
union all select 'source_hit', id from born where t >= 300""",
        ),
        "active_objects_cascade": sql(
            *world(), *active(rocks="world"), then="select type, id, name, pos_r, octant, collided_s from active"
        ),
        "observe_octant_cascade": sql(
            *world(), *active(rocks="world"), then=f"select {TELESCOPE} from active where octant = 1"
        ),
        "impacts_cascade": sql(
            *world(), IMPACTS.replace("from rocks", "from world"), then="select * from impacts"
        ),
        "history_with_deletes": sql(
            CHANGES,
            then="""select * from (select obj_id, seq, status, amount, changed_at as valid_from,
 lead(changed_at) over (partition by obj_id order by changed_at, seq) as valid_to from changes)
where status <> 'P'""",
        ),
        "validate_launch_times": sql(
            *timed_requests(), then="select event_id, name, fired, reject_reason from timed"
        ),
        "accepted_slugs": sql(
            *timed_requests(),
            then="""select event_id as id, name, cast(null as varchar) as target,
 (epoch_us(coalesce(launch, ts)) - epoch_us(timestamp '2024-01-01 00:00:00')) / 1e6 as fired_s, theta,
 cast(0.1 as double) as phi, cast(50 as double) as v from timed where reject_reason is null""",
        ),
    }
    out["ordered_matching_classes"] = out["ordered_matching_rounds"] = out["ordered_matching"]
    out["contention_totals"] = sql(
        *CANDS,
        then="""select 'rock' as kind, rock as id, count(*) as pairs from candidates group by rock
union all select 'slug', slug, count(*) from candidates group by slug""",
    )
    out["sql_collisions"] = sql(
        *BASE,
        *of_slug[len(BASE) :],
        f"k as (select {th('theta')} as theta, {ph('phi')} as phi, count(*) as n from slugs group by 1, 2)",
        then=f"""select {", ".join("c." + x for x in verdict.split(", "))}, r.name as rock_name, k.n as slugs_at_bearing
 from of_slug c join rocks r on r.id = c.rock
 left join k on k.theta = {th("c.pos_theta")} and k.phi = {ph("c.pos_phi")}""",
    )
    out["sql_hits"] = sql(
        ROCKS,
        "two as (select 1 as id, 'a' as name, cast(0 as double) as fired_s, cast(0.1 as double) as theta,"
        " cast(0.1 as double) as phi, cast(50 as double) as v"
        " union all select 2, 'b', cast(0 as double), cast(0.1 as double), cast(0.1 as double), cast(5 as double))",
        candidates("met", "rocks", "two"),
        then="""select two.v, arg_min(rock, row(t, rock)) as rock, min(t) as t from two left join met on slug = two.id
group by two.v""",
    )
    feeds = (
        ROCKS,
        SLUGS,
        """rock_feed as (select id as rock, timestamp '1991-12-31 23:00:00' as since, mass from rocks
 union all select l_suppkey, l_shipdate, cast(1 + (count(*) + floor(max(l_quantity))) % 9 as bigint)
 from lineitem group by all)""",
        """slug_feed as (select id as slug, timestamp '1991-12-31 23:00:00' as since, -1 as seq, v, false as gone from slugs
 union all select o_custkey, o_orderdate, o_orderkey, cast(1 + o_orderkey % 20 as double), o_orderstatus = 'P'
 from orders)""",
        """hit_feed as (select o_custkey as slug, l_shipdate as since, max(l_orderkey * 8 + l_linenumber) as hit_no,
 max(l_suppkey) as rock, bool_or(l_returnflag = 'R') as gone from lineitem join orders on l_orderkey = o_orderkey
 group by all)""",
    )
    # A replay of the feeds up to the day: the last version of each object, no periods.
    replay = (
        "select * from {0}_feed where since <= timestamp '1998-01-01 00:00:00'"
        " qualify row_number() over (partition by {0} order by since desc{1}) = 1"
    )
    # The hits' feed is per slug.
    hits_then = replay.format("hit", "").replace("partition by hit", "partition by slug")
    out["recorded_world"] = sql(
        *feeds,
        then=f"""select h.slug, h.hit_no, h.rock, r.mass, s.v from ({hits_then}) h
 join ({replay.format("rock", "")}) r using (rock) join ({replay.format("slug", ", seq desc")}) s on s.slug = h.slug
 where not h.gone and not s.gone""",
    )
    out["recorded_hits"] = sql(
        *feeds,
        "r as (select *, coalesce(lead(since) over (partition by rock order by since), timestamp '2005-01-01') as til"
        " from rock_feed)",
        "s as (select *, coalesce(lead(since) over (partition by slug order by since, seq), timestamp '2005-01-01') as til"
        " from slug_feed)",
        "h as (select *, coalesce(lead(since) over (partition by slug order by since), timestamp '2005-01-01') as til"
        " from hit_feed)",
        """states as (select h.hit_no, h.slug, h.rock, r.mass, s.v, greatest(h.since, r.since, s.since) as a,
 least(h.til, r.til, s.til) as b from h join r on r.rock = h.rock and r.since < h.til and h.since < r.til
 join s on s.slug = h.slug where not h.gone and not s.gone)""",
        then="""select hit_no, slug, rock, count(*) as states, cast(sum(date_diff('day', a, b)) as bigint) as days,
 cast(sum(date_diff('day', a, b) * mass) as bigint) as mass_days, max(v) as top_v from states where a < b
 group by hit_no, slug, rock""",
    )
    out["kept_speed_counts"] = sql(
        SLUGS,
        then="""select target, cast(case when id % 10 = 0 then v * 10 else v end as bigint) as speed, count(*) as n,
 cast(sum(id) as bigint) as ids from slugs where id % 7 <> 0 group by all""",
    )
    out["cascading_delete"] = sql(
        *world(),
        "fallen as (select id from world where id < 1000000000000 and id % 3 = 0"
        " union all select w.id from world w join fallen f on w.id - 1000000000000 = f.id)",
        then="""select id, name, id // 1000000000000 as generation from world
where id not in (select id from fallen)""",
    )
    out["lineage_closure"] = sql(
        "fallen as (select c_custkey as id from customer where c_custkey // 2 in (5, 14) and c_custkey > 1"
        " union all select c_custkey from customer join fallen on c_custkey // 2 = id and c_custkey > 1)",
        then="select distinct id from fallen",
    )
    for rule, suffix in (("reference", ""), ("continuous", "_continuous")):
        out[f"cascade_hits{suffix}"] = sql(
            *cascade(rule), then="select rock, slug, t from g where rock is not null"
        )
        out[f"cascade_fragments{suffix}"] = sql(
            *cascade(rule), then=f"select {frag_params.format(roman('gen'))} from fragments"
        )
    return out

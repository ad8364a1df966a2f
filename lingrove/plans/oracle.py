"""DuckDB SQL for the queries, put together from the same steps: hexadecimal text, n-grams, models, scores.

Written on its own: it shares only constants with the Spark side.
"""

from __future__ import annotations

from ..functions.scaling import BIGRAM_WEIGHT, POWER, RATIO, SURE, TOP_N, length_factor

K = 5000
CUT = 256  # bytes of a piece: taking a part of a long string costs its length


def grams(source: str, ids: str, low: int, high: int, hx: str = "hx") -> str:
    """Rows (ids, l, i, k): every n-gram of low..high bytes with its start."""
    sizes = ", ".join(f"({n})" for n in range(low, high + 1))
    cuts = f"(select {ids}, {hx}, l, unnest(range(0, cast((length({hx}) // 2 - l) // {CUT} + 1 as bigint))) as c from {source}, (values {sizes}) sizes(l) where length({hx}) >= 2 * l)"
    parts = f"(select {ids}, l, c, substr({hx}, cast({2 * CUT} * c + 1 as int), {2 * CUT + 2 * (high - 1)}) as p, length({hx}) // 2 - l + 1 - {CUT} * c as m from {cuts})"
    return f"(select {ids}, l, {CUT} * c + i as i, substr(p, cast(2 * i + 1 as int), 2 * l) as k from (select {ids}, l, c, p, unnest(range(0, cast(least({CUT}, m) as bigint))) as i from {parts}))"


def quant(f: str) -> str:
    steps = " ".join(f"when {f} >= {least} then {f} - {f} % {unit}" for least, unit in ((1 << 30, 131072), (1 << 28, 32768), (1 << 26, 8192)))
    return f"cast(case when {f} <= 0 then 0 {steps} else greatest({f} - {f} % 2048, 2048) end as bigint)"


def scaled(count: str, total: str) -> str:
    return f"cast(greatest(1, least(4294967295, floor(1e9 * pow(cast(100.0 as double) * (cast({count} as double) / {total}), cast({POWER} as double)) + 0.5))) as bigint)"


TRI = f"""with
h as materialized (select doc_id, lang as grp, hex(encode(text)) as hx from documents where text is not null and lang is not null),
tot as (select grp, cast(sum(length(hx) // 2) as bigint) as total from h group by grp),
ids as (select grp, cast(dense_rank() over (order by grp) - 1 as int) as lang_id, total from tot),
tri as materialized (select grp, k, cast(count(*) as bigint) as cnt from {grams("h", "grp", 3, 3)} group by grp, k)"""

BI = """,
bi as (select grp, substr(k, 1, 4) as k, cast(sum(cnt) as bigint) as cnt from tri group by all)"""

TOP = f"""{TRI},
t3 as materialized (select grp, k, cnt from tri where cnt >= 2 and k not in ('000000', 'FFFFFF') qualify rank() over (partition by grp order by cnt desc) <= {K})"""


def one_pass(name: str, before: str, low: int, high: int) -> str:
    p = name
    return f""",
{p}_g as materialized (select g.grp, g.k, cast(count(*) as bigint) as cnt from {grams("h", "grp", low, high)} g semi join (select grp, k from {before} where length(k) = {2 * (low - 1)}) b on g.grp = b.grp and substr(g.k, 1, {2 * (low - 1)}) = b.k group by g.grp, g.k),
{p}_a as (select grp, k, cnt from {before} union all select grp, k, cnt from {p}_g),
{p}_s as (select grp, substr(k, 3) as k, max(cnt) as longer from {p}_a where length(k) // 2 between {low + 2} and {high} group by grp, substr(k, 3)),
{p}_b as materialized (select a.grp, a.k, cast(case when s.longer >= cast(0.9 as double) * a.cnt then 0 else a.cnt end as bigint) as cnt from {p}_a a left join {p}_s s on a.grp = s.grp and a.k = s.k),
{p}_c as (select grp, substr(k, 1, length(k) - 2) as k, max(cnt) as child from {p}_b group by all),
{p}_d as (select b.grp, b.k, b.cnt from {p}_b b left join {p}_c c on b.grp = c.grp and b.k = c.k where b.cnt > 0 and length(b.k) >= 6 and (coalesce(c.child, 0) < cast(0.9 as double) * b.cnt or (length(b.k) = 6 and coalesce(c.child, 0) < cast(0.995 as double) * b.cnt))),
{p} as materialized (select grp, k, cnt from (select *, rank() over (partition by grp order by cnt desc) as r, count(*) over (partition by grp) as n from {p}_d) where n < {K} or (r <= {K} and cnt >= 2))"""


def model(longer: str, name: str = "mo") -> str:
    """A smoothed and quantised model from the n-grams ``longer`` and the bigrams."""
    return f""",
{name} as materialized (select lang_id, grp as lang, cast(length(k) // 2 as int) as len, k, cnt, scaled, {quant("scaled")} as quant, false as is_stop
  from (select i.lang_id, a.grp, a.k, a.cnt, {scaled("a.cnt", "i.total")} as scaled from (select grp, k, cnt from {longer} union all select grp, k, cnt from bi where cnt >= 2) a join ids i on a.grp = i.grp))"""


PASS1 = TOP + one_pass("m1", "t3", 4, 6)
MODEL = PASS1 + one_pass("m2", "m1", 7, 8) + BI + model("m2")


def score_expr(bigram_weight: float = BIGRAM_WEIGHT, penalty: float = -9.0, n: str = "n_bytes") -> str:
    terms = [f"(s{k} * cast({length_factor(k, bigram_weight)!r} as double) + p{k} * cast({length_factor(k, bigram_weight) * penalty!r} as double))" for k in range(2 if bigram_weight > 0 else 3, 9)]
    out = terms[0]
    for t in terms[1:]:
        out = f"({out} + {t})"
    return f"round({out} / (cast(1e11 as double) * {n}), 6)"


def sums(source: str, ids: str, model: str = "mo", low: int = 2, high: int = 8, where: str = "true") -> str:
    """Select of (ids, n_bytes, lang_id, s2, p2, ...) for strings (ids, hx)."""
    cells = ", ".join(f"cast(coalesce(sum(quant) filter (len = {n} and {'' if c == 'p' else 'not '}is_stop), 0) as bigint) as {c}{n}" for n in range(2, 9) for c in "sp")
    found = grams(f"(select *, length(hx) // 2 as n_bytes from {source})", ids + ", n_bytes", low, high)
    return f"select {ids}, n_bytes, lang_id, {cells} from (select {ids}, n_bytes, l, i, k from {found}) g join {model} m on g.k = m.k and {where} group by {ids}, n_bytes, lang_id"


def scored(source: str, ids: str, name: str = "sc", bigram_weight: float = BIGRAM_WEIGHT, **how) -> str:
    return f",\n{name} as materialized (select {ids}, n_bytes, lang_id, {score_expr(bigram_weight)} as score from ({sums(source, ids, **how)}))"


CONV = ",\nc as materialized (select conv_id, turn, row_number() over (partition by conv_id, turn order by role, text) as part, hex(encode(text)) as hx from conversations where text is not null)"
TURN = "conv_id, turn, part"


def ranked(ids: str, source: str = "sc") -> str:
    return f"(select *, row_number() over (partition by {ids} order by score desc, lang_id) as rank, max(score) over (partition by {ids}) as best from {source})"


def report_where() -> str:
    return f"score > cast({SURE} as double) and score >= cast({RATIO} as double) * best and rank <= {TOP_N}"


def cut_where() -> str:
    return f"score >= greatest(cast({SURE} as double), cast({RATIO} as double) * best) or (best < cast({SURE} as double) and rank = 1)"

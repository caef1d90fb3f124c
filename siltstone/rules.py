"""Queries whose SQL follows an operator's own rule, step by step: cuts, read units, groups, skip groups, adjacency.

Turns of conversations stand for chunks where the rule needs files of many chunks that SQL can cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import chunk as chunking
from .operators import dedup, layout, similar
from .sources import payloads

#: Bytes of a read unit over turns, small enough to divide most conversations.
UNIT = 600


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    """Every turn with a text as a chunk of its conversation."""
    t = spark.read.parquet(f"{sf}/conversations.parquet").where("text <> ''")
    by_turn = Window.partitionBy("conv_id").orderBy("turn")
    size = F.octet_length("text").cast("long")
    return t.select(
        F.col("conv_id").alias("file_id"), F.col("conv_id").alias("file_ord"), (F.row_number().over(by_turn) - 1).alias("seq"),
        (F.sum(size).over(by_turn.rowsBetween(Window.unboundedPreceding, 0)) - size).alias("src_offset"), size.alias("chunk_size"), F.sha1("text").alias("chunk_hash"), "text")


def ae_cuts(spark: SparkSession, sf: str) -> DataFrame:
    """Where asymmetric extremum cuts every document."""
    c = chunking.chunk(payloads.from_table(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text"), "ae")
    return c.select(F.col("file_id").alias("doc_id"), F.col("seq").cast("long").alias("seq"), "src_offset", F.col("chunk_size").cast("long").alias("n"))


def turn_units(spark: SparkSession, sf: str) -> DataFrame:
    """The reads that serve all distinct turns, in order of their first arrival."""
    placed = layout.layout(dedup.unique_chunks(_turns(spark, sf).drop("text")), ["first_file", "first_seq"])
    return layout.read_units(placed, UNIT).select("run", "unit_no", F.col("file_id").alias("conv_id"), "offset", "length", F.col("lifetime").cast("long").alias("lifetime"))


def turn_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Leader groups of turns by two plain signatures: characters, and characters that aren't spaces modulo 50."""
    signature = F.array(F.length("text").cast("long"), (F.length(F.replace("text", F.lit(" "), F.lit(""))) % 50).cast("long"))
    t = _turns(spark, sf).select((F.col("file_ord") * 1000000 + F.col("seq")).alias("arrival"), signature.alias("super_features"))
    return similar.leaders(t)


def turn_skip_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct turns that follow the same turn share the group of the first of them."""
    return similar.skip_groups(dedup.successors(_turns(spark, sf).drop("text"))).select(F.col("chunk_hash").alias("h"), F.col("leader").alias("leader"))


def turn_adjacency(spark: SparkSession, sf: str) -> DataFrame:
    """The order of distinct turns beside duplicates of others."""
    o = similar.duplicate_adjacency(_turns(spark, sf).drop("text"))
    return o.select(F.col("chunk_hash").alias("h"), "anchor_file", F.col("anchor_seq").cast("long").alias("anchor_seq"), F.col("side").cast("long").alias("side"))


QUERIES = {f.__name__: f for f in (ae_cuts, turn_units, turn_groups, turn_skip_groups, turn_adjacency)}

_TURNS = """t as (select conv_id, row_number() over (partition by conv_id order by turn) - 1 as seq, cast(octet_length(encode(text)) as bigint) as n, sha1(text) as h, text from conversations where text <> ''),
    o as (select *, cast(coalesce(sum(n) over (partition by conv_id order by seq rows between unbounded preceding and 1 preceding), 0) as bigint) as off from t),
    f as (select *, row_number() over (partition by h order by conv_id, seq) = 1 as is_first,
                 first_value(conv_id) over (partition by h order by conv_id, seq) as first_conv, first_value(seq) over (partition by h order by conv_id, seq) as first_seq from o)"""

ORACLE_SQL = {
    "ae_cuts": f"""with recursive raw as (select doc_id, regexp_extract_all(hex(text), '..') as x from documents where text <> ''),
        byte as (select doc_id, len(x) as n, unnest(range(len(x))) as i, ('0x' || unnest(x))::UBIGINT as b from raw where len(x) >= 4760),
        value as (select doc_id, n, i, b + {" + ".join(f"lead(b, {k}) over w * {256**k}::UBIGINT" for k in range(1, 8))} as v from byte window w as (partition by doc_id order by i) qualify i <= n - 8),
        ahead as (select doc_id, i, v, max(v) over (partition by doc_id order by i rows between 1 following and 4767 following) as m from value),
        held as (select doc_id, list(i order by i) as p from ahead where m is null or m <= v group by doc_id),
        cut as (select doc_id, cast(len(x) as bigint) as n, p, cast(-1 as bigint) as seq, cast(0 as bigint) as start, cast(0 as bigint) as stop from raw left join held using (doc_id)
            union all select doc_id, n, p, seq + 1, stop, case when n - stop < 4760 or [q for q in p if q >= stop][1] = n - 8 then n else least([q for q in p if q >= stop][1] + 4767, n - 8) end from cut where stop < n)
        select doc_id, seq, start as src_offset, stop - start as n from cut where seq >= 0""",
    "turn_units": f"""with recursive {_TURNS}, u as (select conv_id, off, n, row_number() over (order by conv_id, seq) as k from f where is_first),
        s as (select *, dense_rank() over (order by conv_id) - 1 as run, row_number() over (partition by conv_id order by k) as r from u),
        fold as (select run, r, conv_id, cast(0 as bigint) as unit_no, off as lo, off + n as hi from s where r = 1
            union all select s.run, s.r, s.conv_id, case when greatest(hi, off + n) - least(lo, off) <= {UNIT} then unit_no else unit_no + 1 end,
                case when greatest(hi, off + n) - least(lo, off) <= {UNIT} then least(lo, off) else off end, case when greatest(hi, off + n) - least(lo, off) <= {UNIT} then greatest(hi, off + n) else off + n end
                from fold join s on s.run = fold.run and s.r = fold.r + 1)
        select run, unit_no, any_value(conv_id) as conv_id, min(lo) as "offset", max(hi) - min(lo) as length, count(*) as lifetime from fold group by run, unit_no""",
    "turn_groups": f"""with recursive {_TURNS}, s as (select conv_id * 1000000 + seq as arrival, cast(length(text) as bigint) as x, cast(length(replace(text, ' ', '')) % 50 as bigint) as y, row_number() over (order by conv_id, seq) as k from t),
        g as (select cast(0 as bigint) as k, cast(null as bigint) as arrival, cast(null as bigint) as leader, cast([] as struct(a bigint, x bigint, y bigint)[]) as led
            union all select s.k, s.arrival, coalesce([q for q in led if q.x = s.x][1].a, [q for q in led if q.y = s.y][1].a, s.arrival),
                case when coalesce([q for q in led if q.x = s.x][1].a, [q for q in led if q.y = s.y][1].a) is null then list_append(led, {{'a': s.arrival, 'x': s.x, 'y': s.y}}) else led end
                from g join s on s.k = g.k + 1)
        select arrival, leader from g where k > 0""",
    "turn_skip_groups": f"""with {_TURNS}, p as (select u.h, u.conv_id, u.seq, b.h as before from f as u left join t as b on b.conv_id = u.conv_id and b.seq = u.seq - 1 where u.is_first),
        l as (select *, row_number() over (partition by before order by conv_id, seq) as r from p where before is not null)
        select p.h, coalesce(l.h, p.h) as leader from p left join l on l.before = p.before and l.r = 1""",
    "turn_adjacency": f"""with {_TURNS}, w as (select *, last_value(case when not is_first then {{'s': seq, 'c': first_conv, 'q': first_seq}} end ignore nulls) over (partition by conv_id order by seq rows between unbounded preceding and 1 preceding) as prev,
            first_value(case when not is_first then {{'s': seq, 'c': first_conv, 'q': first_seq}} end ignore nulls) over (partition by conv_id order by seq rows between 1 following and unbounded following) as next from f)
        select h, case when seq - prev.s <= 5 then prev.c when next.s - seq <= 5 then next.c else conv_id end as anchor_file,
            case when seq - prev.s <= 5 then prev.q when next.s - seq <= 5 then next.q else seq end as anchor_seq, cast(case when seq - prev.s <= 5 then 1 when next.s - seq <= 5 then -1 else 0 end as bigint) as side from w where is_first""",
}

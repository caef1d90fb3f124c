"""Named queries over the standard tables, and the SQL that checks them."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rules
from .functions.hashes import fnv1_64_many, spooky64
from .functions.kernels import FeatureParams
from .operators import chunk as chunking
from .operators import codecs, dedup, layout, similar
from .plans.archive import Archive
from .plans.storage import fresh_path, materialise, small_batches
from .sources import payloads
from .sources.container import restore_container
from .streaming.ingest import ingest_available

#: The longest payload that asymmetric extremum leaves whole, and its least chunk but for a text's last two.
AE_WHOLE, AE_LEAST = 4759, 4767


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return payloads.from_table(_docs(spark, sf), "doc_id", "text")


def _whole(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as one chunk: what SQL can follow."""
    return _chunks(spark, sf, "whole")


def _chunks(spark: SparkSession, sf: str, method: str) -> DataFrame:
    return chunking.chunk(_files(spark, sf), method)


def _hex(c: str = "chunk_hash"):
    return F.lower(F.hex(c))


def _long(c):
    return F.col(c).cast("long")


def _sized(restored: DataFrame) -> DataFrame:
    """(doc_id, n, h) of restored files."""
    return restored.select(F.col("file_id").alias("doc_id"), F.octet_length("data").cast("long").alias("n"), F.sha1("data").alias("h"))


# scans, totals


def file_scan(spark, sf):
    return _files(spark, sf).select(F.col("file_id").alias("doc_id"), F.octet_length("data").cast("long").alias("n"), F.sha1("data").alias("h"))


def job_totals(spark, sf):
    return _files(spark, sf).agg(F.count("*").alias("files"), F.sum(F.octet_length("data").cast("long")).alias("bytes"), F.countDistinct(F.sha1("data")).alias("unique_payloads"))


def totals_rollup(spark, sf):
    d = _docs(spark, sf)
    return d.rollup("lang", "source").agg(F.count("*").alias("files"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))


def job_stats(spark, sf, method="whole"):
    return Archive(_files(spark, sf), method).stats()


def conversation_files(spark, sf):
    files = payloads.from_parts(spark.read.parquet(f"{sf}/conversations.parquet"), "conv_id", "turn", "text")
    return files.select(F.col("file_id").alias("conv_id"), F.octet_length("data").cast("long").alias("n"), F.sha1("data").alias("h"))


def folder_scan(spark, sf):
    found = payloads.from_folder(spark, f"{sf}/region.parquet", f"{sf}/nation.parquet")
    return found.select(F.regexp_extract("filename", r"[^/]+$", 0).alias("name"), (F.octet_length("data") > 0).alias("nonempty"))


# chunkers


def _roundtrip(spark, sf, method, files=None):
    files = files if files is not None else _files(spark, sf)
    chunks = chunking.chunk(files, method, with_data=True)
    listed = chunks.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("seq", "data"))).alias("p"))
    return _sized(listed.select("file_id", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.data))").alias("data")))


def whole_chunks(spark, sf):
    c = _whole(spark, sf)
    return c.select(F.col("file_id").alias("doc_id"), _long("seq").alias("seq"), "src_offset", _long("chunk_size").alias("chunk_size"), _hex().alias("h"))


def _bounds(chunks: DataFrame, whole: int, least: int, most: int, tail: int) -> DataFrame:
    """(file_id, n, within): short files are one chunk; but for the last `tail`, chunks keep within the bounds."""
    size = chunks.groupBy("file_id").agg(F.max("seq").alias("last"), F.sum(_long("chunk_size")).alias("n"))
    ok = F.when(F.col("n") <= whole, F.col("last") == 0).otherwise((F.col("seq") > F.col("last") - tail) | F.col("chunk_size").between(least, most))
    return chunks.join(size, "file_id").groupBy("file_id").agg(F.max("n").alias("n"), F.min(ok).alias("within"))


def ae_bounds(spark, sf):
    return _bounds(chunking.chunk(_files(spark, sf), "ae"), AE_WHOLE, AE_LEAST, 1 << 31, 2).withColumnRenamed("file_id", "doc_id")


def ae_roundtrip(spark, sf):
    return _roundtrip(spark, sf, "ae")


def rabin_roundtrip(spark, sf):
    return _roundtrip(spark, sf, "rabin")


def pages_roundtrip(spark, sf):
    files = payloads.from_table(spark.read.parquet(f"{sf}/pages.parquet"), "page_id", "html")
    return _roundtrip(spark, sf, "rabin", files).withColumnRenamed("doc_id", "page_id")


def rabin_bounds(spark, sf):
    return _bounds(chunking.chunk(_files(spark, sf), "rabin"), 2048, 2048, 65536, 1).withColumnRenamed("file_id", "doc_id")


def rabin_source_bounds(spark, sf):
    """The same for the documents of each source as one file."""
    d = payloads.from_parts(_docs(spark, sf).withColumn("s", F.expr("cast(substring(source, 4) as bigint)")), "s", "doc_id", "text")
    return _bounds(chunking.chunk(d, "rabin"), 2048, 2048, 65536, 1).withColumnRenamed("file_id", "source_no")


# duplicates


def dedup_first(spark, sf, method="whole"):
    u = dedup.unique_chunks(_chunks(spark, sf, method))
    return u.select(_hex().alias("h"), F.col("file_id").alias("doc_id"), _long("chunk_size").alias("n"), F.col("occurrences"))


def dup_occurrences(spark, sf, method="whole"):
    c = dedup.with_first(_chunks(spark, sf, method)).where("not is_unique")
    return c.select(F.col("file_id").alias("doc_id"), F.col("first_file").alias("first_doc"), _hex().alias("h"))


def dup_group_sizes(spark, sf, method="whole"):
    u = dedup.unique_chunks(_chunks(spark, sf, method))
    return u.groupBy(F.col("occurrences").alias("size")).agg(F.count("*").alias("groups"))


def dedup_by_lang(spark, sf, method="whole"):
    d = _docs(spark, sf)
    c = dedup.with_first(_chunks(spark, sf, method)).join(d.select(F.col("doc_id").alias("file_id"), "lang"), "file_id")
    return c.groupBy("lang").agg(
        F.count("*").alias("occurrences"), F.count(F.when(F.col("is_unique"), 1)).alias("uniques"), F.sum(_long("chunk_size")).alias("bytes"),
        F.coalesce(F.sum(F.when(F.col("is_unique"), _long("chunk_size"))), F.lit(0)).alias("unique_bytes"))


def index_lookup(spark, sf):
    c = _whole(spark, sf)
    index = dedup.unique_chunks(c).select("chunk_hash", F.col("file_id").alias("first_doc"))
    return dedup.lookup(c, index).select(F.col("file_id").alias("doc_id"), "first_doc")


def last_position(spark, sf):
    return dedup.last_position(_whole(spark, sf)).select(_hex().alias("h"), F.col("file_ord").alias("last_doc"))


def new_vs_base(spark, sf):
    """The labelled documents are the base; which of the others are new?"""
    c = _whole(spark, sf)
    known = spark.read.parquet(f"{sf}/labels.parquet").select(F.col("doc_id").alias("file_id"))
    fresh = dedup.new_against(c.join(known, "file_id", "left_anti"), c.join(known, "file_id", "left_semi"))
    return fresh.select(F.col("file_id").alias("doc_id"), _hex().alias("h"))


def stream_ingest(spark, sf, method="whole"):
    docs = _docs(spark, sf)
    out = ingest_available(spark, f"{sf}/documents.parquet", docs, "doc_id", "text", method)
    return out.select(_hex().alias("h"), F.col("chunk_size").alias("n"))


# layout, recipes, restore


def layout_arrival(spark, sf, method="whole"):
    return Archive(_files(spark, sf), method).layout.select(_hex().alias("h"), "layout_ord", "packed_offset", _long("chunk_size").alias("n"))


def recipe_rewrite(spark, sf, method="whole"):
    return Archive(_files(spark, sf), method).recipes.select(F.col("file_id").alias("doc_id"), _long("seq").alias("seq"), "packed_offset", _long("chunk_size").alias("n"))


def recipe_unresolved(spark, sf):
    a = Archive(_files(spark, sf), "rabin")
    return layout.unresolved(a.chunks, a.layout).agg(F.count("*").alias("unresolved"))


def restore(spark, sf):
    return _sized(Archive(_files(spark, sf), "ae", "grouped").restored())


def restore_adjacent(spark, sf):
    return _sized(Archive(_files(spark, sf), "rabin", "adjacent").restored())


def header_size(spark, sf):
    return layout.header_bytes(_files(spark, sf), _whole(spark, sf))


def container_roundtrip(spark, sf, method="whole"):
    path = fresh_path(spark, "container") + "/archive.bin"
    Archive(_files(spark, sf), method).write(path)
    return restore_container(spark, path).select("filename", "file_size", "chunk_count", F.sha1("data").alias("h"))


def read_units(spark, sf):
    limit = 65536
    a = Archive(_files(spark, sf), "ae")
    u = layout.read_units(a.layout, limit)
    return u.agg(F.sum(_long("lifetime")).alias("chunks"), F.sum("length").alias("bytes"), (F.max(F.when(F.col("lifetime") > 1, F.col("length"))) <= limit).alias("within")).select(
        (F.col("chunks") == a.unique.count()).alias("all_chunks"), F.coalesce("within", F.lit(True)).alias("within"))


# codecs


def codec_roundtrip(spark, sf):
    files = _files(spark, sf).select("file_id", "data")
    out = None
    for name in codecs.CODECS:
        back = _sized(codecs.decompress(codecs.compress(files, name), name)).withColumn("codec", F.lit(name))
        out = back if out is None else out.unionByName(back)
    return out


def codec_sniff(spark, sf):
    files = _files(spark, sf).select("file_id", "filename", "data")
    gz = codecs.compress(files, "gzip").select("file_id", F.concat("filename", F.lit(".gz")).alias("filename"), "packed")
    bz = codecs.compress(files, "bzip2").select("file_id", F.concat("filename", F.lit(".bz2")).alias("filename"), "packed")
    wrong = codecs.compress(files, "zlib").select("file_id", F.concat("filename", F.lit(".gz")).alias("filename"), "packed")
    return gz.union(bz).union(wrong).groupBy(F.coalesce(codecs.sniffed(F.col("filename"), F.col("packed")), F.lit("rejected")).alias("form")).agg(F.count("*").alias("files"))


def compression_gain(spark, sf):
    """Compressed bytes of the packed data in each layout order."""
    out = None
    for order in ("arrival", "grouped"):
        data = materialise(layout.segments(Archive(_files(spark, sf), "rabin", order).packed), "segments")
        for name in ("gzip", "bzip2", "lzma", "lz4", "zstd"):
            row = codecs.compress(data, name).agg(F.sum("size").alias("bytes"), F.sum(F.octet_length("packed").cast("long")).alias("compressed")).select(F.lit(name).alias("codec"), F.lit(order).alias("layout"), "bytes", "compressed")
            out = row if out is None else out.unionByName(row)
    return out


# features and groups


def super_features(spark, sf):
    """Every document's features as a whole: equal for equal payloads, and as many as asked for."""
    f = similar.with_super_features(chunking.chunk(_files(spark, sf), "whole", with_data=True))
    return f.groupBy(_hex().alias("h")).agg(F.count("*").alias("files"), F.countDistinct("super_features").alias("signatures"), F.max(F.size("super_features")).cast("long").alias("width"))


def super_features_wide(spark, sf):
    f = similar.with_super_features(chunking.chunk(_files(spark, sf), "whole", with_data=True), FeatureParams(4, 16))
    return f.groupBy(_hex().alias("h")).agg(F.countDistinct("super_features").alias("signatures"), F.max(F.size("super_features")).cast("long").alias("width"))


def sf_short(spark, sf):
    """Payloads shorter than a window all have one signature."""
    f = similar.with_super_features(chunking.chunk(_files(spark, sf), "whole", with_data=True))
    short = F.col("chunk_size") < 48
    return f.agg(F.count("*").alias("files"), F.count(F.when(short, 1)).alias("short_files"), F.countDistinct(F.when(short, F.col("super_features"))).alias("short_signatures"))


def similar_groups(spark, sf):
    """Members of all groups, how many of them don't come before their leader, and how many groups their own leader leads or nobody."""
    g = Archive(_files(spark, sf), "whole").groups
    groups = g.groupBy("leader").agg(F.count("*").alias("n"), F.count(F.when(F.col("arrival") >= F.col("leader"), 1)).alias("later"), F.count(F.when(F.col("arrival") == F.col("leader"), 1)).alias("own"))
    return groups.agg(F.sum("n").alias("members"), F.sum("later").alias("not_before"), F.count(F.when(F.col("own") != 1, 1)).alias("without_leader"))


def similar_leaders(spark, sf, method="whole"):
    """Every unique chunk with the first chunk of its group."""
    g = Archive(_files(spark, sf), method).groups
    place = lambda c, a: [F.col(f"{c}.first_file").alias(f"{a}doc"), _long(f"{c}.first_seq").alias(f"{a}seq")]
    return g.select(*place("arrival", ""), *place("leader", "leader_"))


def skip_groups(spark, sf):
    c = chunking.chunk(_files(spark, sf), "ae")
    s = dedup.successors(c)
    return similar.skip_groups(s).groupBy("leader").agg(F.count("*").alias("members")).agg(F.sum("members").alias("members"), F.count("*").alias("groups"))


def dup_adjacency(spark, sf):
    """The order is a permutation of the unique chunks."""
    o = similar.duplicate_adjacency(_whole(spark, sf))
    return o.agg(F.count("*").alias("rows"), F.countDistinct("chunk_hash").alias("uniques"))


# hashes and texts


def _hashed(df: DataFrame, many, name: str) -> DataFrame:
    import pyarrow as pa

    small_batches(df.sparkSession)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([str(int(x)) for x in many([t.encode() for t in b.column("t").to_pylist()])], pa.string())], ["doc_id", name])

    return df.mapInArrow(run, f"doc_id long, {name} string")


def fnv1_64(spark, sf):
    return _hashed(_docs(spark, sf).select("doc_id", F.col("text").alias("t")), fnv1_64_many, "fnv")


def spooky(spark, sf):
    return _hashed(_docs(spark, sf).select("doc_id", F.col("text").alias("t")), lambda rows: [spooky64(x) for x in rows], "spooky")


def restore_paths(spark, sf):
    p = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", F.concat(F.when(F.col("page_id") % 3 == 0, "../x/./").when(F.col("page_id") % 3 == 1, "a/../../").otherwise("./"), "url").alias("name"))
    return p.select("page_id", payloads.restore_path_column(F.col("name")).alias("path"))


def archive_names(spark, sf):
    p = spark.read.parquet(f"{sf}/pages.parquet")
    return p.select("page_id", payloads.archive_name_column(F.concat("url", F.when(F.col("page_id") % 2 == 0, "//").otherwise(""))).alias("name"))


def changed_paths(spark, sf):
    """File names moved to another folder, extension kept."""
    p = spark.read.parquet(f"{sf}/pages.parquet")
    return p.select("page_id", F.concat(F.lit("out/"), F.regexp_extract("url", r"[^/]*$", 0)).alias("path"))


def hex_dump(spark, sf):
    c = _whole(spark, sf)
    return c.select(F.col("file_id").alias("doc_id"), F.upper(F.hex("chunk_hash")).alias("line"))


def recipe_text(spark, sf):
    r = Archive(_files(spark, sf), "whole").recipes
    return r.select(F.col("file_id").alias("doc_id"), F.format_string("Offset: %d Size: %d", F.col("packed_offset"), F.col("chunk_size")).alias("line"))


QUERIES = {f.__name__: f for f in (
    file_scan, job_totals, totals_rollup, job_stats, conversation_files, folder_scan, whole_chunks, ae_bounds, ae_roundtrip, rabin_roundtrip, pages_roundtrip, rabin_bounds, rabin_source_bounds,
    dedup_first, dup_occurrences, dup_group_sizes, dedup_by_lang, index_lookup, last_position, new_vs_base, stream_ingest, layout_arrival, recipe_rewrite, recipe_unresolved,
    restore, restore_adjacent, header_size, container_roundtrip, read_units, codec_roundtrip, codec_sniff, compression_gain, super_features, super_features_wide, sf_short,
    similar_groups, similar_leaders, skip_groups, dup_adjacency, fnv1_64, spooky, restore_paths, archive_names, changed_paths, hex_dump, recipe_text)}

#: The same over chunks of the two chunkers, which SQL can't follow; tests compare them with brute force.
CHUNKED = (job_stats, dedup_first, dup_occurrences, dup_group_sizes, dedup_by_lang, stream_ingest, layout_arrival, recipe_rewrite, container_roundtrip, similar_leaders)
QUERIES |= {f"{m}_{f.__name__}": partial(f, method=m) for m in ("ae", "rabin") for f in CHUNKED} | rules.QUERIES

_N = "octet_length(encode(text))"
_DOCS = f"d as (select doc_id, text, lang, cast({_N} as bigint) as n, sha1(text) as h from documents where text <> '')"
_UNIQUE = "u as (select h, n, min(doc_id) as first_doc, count(*) as occurrences from d group by h, n)"
_PLACED = "l as (select *, cast(coalesce(sum(n) over (order by first_doc rows between unbounded preceding and 1 preceding), 0) as bigint) as packed_offset, row_number() over (order by first_doc) - 1 as layout_ord from u)"
_ALL = f"select doc_id, cast({_N} as bigint) as n, sha1(text) as h from documents where text is not null"
_EVERY = "select doc_id, cast(octet_length(encode(coalesce(text, ''))) as bigint) as n, sha1(coalesce(text, '')) as h from documents"
_SOME = f"{_ALL} and text <> ''"
_SOME_N = f"select doc_id, cast({_N} as bigint) as n from documents where text <> ''"

ORACLE_SQL = {
    "file_scan": f"select doc_id, cast({_N} as bigint) as n, sha1(text) as h from documents",
    "job_totals": f"select count(*) as files, cast(sum({_N}) as bigint) as bytes, count(distinct sha1(text)) as unique_payloads from documents",
    "totals_rollup": f"select lang, source, count(*) as files, cast(sum({_N}) as bigint) as bytes from documents group by rollup (lang, source)",
    "job_stats": f"""with {_DOCS}, {_UNIQUE}, f as (select count(*) as files, cast(sum(n) as bigint) as bytes, cast(16 + sum(18 + length('f/' || doc_id) + 12) as bigint) as header_bytes from d)
        select files, bytes, files as chunks, (select count(*) from u) as unique_chunks, (select cast(sum(n) as bigint) from u) as unique_bytes, header_bytes,
               cast(header_bytes + (select sum(n) from u) as bigint) as container_bytes from f""",
    "conversation_files": "select conv_id, cast(octet_length(encode(t)) as bigint) as n, sha1(t) as h from (select conv_id, string_agg(text, '' order by turn) as t from conversations group by conv_id)",
    "folder_scan": "select * from (values ('nation.parquet', true), ('region.parquet', true)) as t(name, nonempty)",
    "whole_chunks": f"with {_DOCS} select doc_id, cast(0 as bigint) as seq, cast(0 as bigint) as src_offset, n as chunk_size, h from d",
    "ae_roundtrip": _SOME,
    "rabin_roundtrip": _SOME,
    "pages_roundtrip": "select page_id, cast(octet_length(encode(html)) as bigint) as n, sha1(html) as h from pages where html <> ''",
    "ae_bounds": f"select *, true as within from ({_SOME_N})",
    "rabin_bounds": f"select *, true as within from ({_SOME_N})",
    "rabin_source_bounds": f"select cast(substring(source, 4) as bigint) as source_no, cast(sum({_N}) as bigint) as n, true as within from documents group by source",
    "dedup_first": f"with {_DOCS}, {_UNIQUE} select h, first_doc as doc_id, n, occurrences from u",
    "dup_occurrences": f"with {_DOCS}, w as (select *, min(doc_id) over (partition by h) as first_doc from d) select doc_id, first_doc, h from w where doc_id <> first_doc",
    "dup_group_sizes": f"with {_DOCS}, {_UNIQUE} select occurrences as size, count(*) as groups from u group by occurrences",
    "dedup_by_lang": f"""with {_DOCS}, w as (select *, row_number() over (partition by h order by doc_id) as r from d)
        select lang, count(*) as occurrences, count(*) filter (where r = 1) as uniques, cast(sum(n) as bigint) as bytes, cast(coalesce(sum(n) filter (where r = 1), 0) as bigint) as unique_bytes from w group by lang""",
    "index_lookup": f"with {_DOCS} select doc_id, min(doc_id) over (partition by h) as first_doc from d",
    "last_position": f"with {_DOCS} select h, max(doc_id) as last_doc from d group by h",
    "new_vs_base": f"with {_DOCS}, k as (select d.*, doc_id in (select doc_id from labels) as known from d) select doc_id, h from k where not known and not exists (select 1 from k as b where b.known and b.h = k.h)",
    "stream_ingest": f"select distinct sha1(text) as h, cast({_N} as bigint) as n from documents where text <> ''",
    "layout_arrival": f"with {_DOCS}, {_UNIQUE}, {_PLACED} select h, layout_ord, packed_offset, n from l",
    "recipe_rewrite": f"with {_DOCS}, {_UNIQUE}, {_PLACED} select d.doc_id, cast(0 as bigint) as seq, l.packed_offset, d.n from d join l using (h)",
    "recipe_unresolved": "select cast(0 as bigint) as unresolved",
    "restore": _EVERY,
    "restore_adjacent": _EVERY,
    "header_size": f"with {_DOCS} select cast(16 + sum(18 + length('f/' || doc_id) + 12) as bigint) as header_bytes from d",
    "container_roundtrip": f"with {_DOCS} select 'f/' || doc_id as filename, n as file_size, cast(1 as bigint) as chunk_count, h from d",
    "read_units": "select true as all_chunks, true as within",
    "codec_roundtrip": f"select a.*, codec from ({_ALL}) as a, (values {', '.join(f"('{c}')" for c in codecs.CODECS)}) as c(codec)",
    "codec_sniff": "select form, count(*) as files from documents, (values ('.gz'), ('.bz2'), ('rejected')) as f(form) group by form",
    "super_features": "select sha1(text) as h, count(*) as files, cast(1 as bigint) as signatures, cast(2 as bigint) as width from documents where text <> '' group by 1",
    "super_features_wide": "select distinct sha1(text) as h, cast(1 as bigint) as signatures, cast(4 as bigint) as width from documents where text <> ''",
    "sf_short": f"select count(*) as files, count(*) filter (where {_N} < 48) as short_files, cast(least(1, count(*) filter (where {_N} < 48)) as bigint) as short_signatures from documents where text <> ''",
    "similar_groups": f"with {_DOCS} select count(distinct h) as members, count(distinct h) as not_before, cast(0 as bigint) as without_leader from d",
    "dup_adjacency": f"with {_DOCS} select count(distinct h) as rows, count(distinct h) as uniques from d",
    "fnv1_64": """select doc_id, cast(list_reduce([('0x' || x)::UHUGEINT for x in regexp_extract_all(hex(text), '..')], lambda h, b: xor((h * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT, b), 14695981039346656037::UHUGEINT) as varchar) as fnv
        from documents""",
    "restore_paths": """select page_id, case when not regexp_matches(bare, '(^|/)\\.\\.(/|$)') then bare end as path from (
        select page_id, regexp_replace(case page_id % 3 when 0 then '../x/./' when 1 then 'a/../../' else './' end || url, '^[./]+', '') as bare from pages)""",
    "archive_names": "select page_id, regexp_extract(rtrim(url, '/'), '[^/]+$', 0) as name from pages",
    "changed_paths": "select page_id, 'out/' || regexp_extract(url, '[^/]*$', 0) as path from pages",
    "hex_dump": f"with {_DOCS} select doc_id, upper(h) as line from d",
    "recipe_text": f"with {_DOCS}, {_UNIQUE}, {_PLACED} select d.doc_id, format('Offset: {{}} Size: {{}}', l.packed_offset, d.n) as line from d join l using (h)",
}

ORACLE_SQL |= rules.ORACLE_SQL


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Files, duplicates and unique bytes by language, chunked by asymmetric extremum."""
    return dedup_by_lang(spark, sf, "ae")

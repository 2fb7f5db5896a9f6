"""Line dedup by content-defined chunks, in DataFrame functions only.

A rolling hash over the hashes of the last two lines decides after which lines a chunk ends, so boundaries move along
with inserted or deleted lines. Chunks of several lines that occur more than once in the whole table are removed but for
their first occurrence, by (doc_id, place). Chunks meet by md5 and then by their very bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm.scratch import Scratch
from framelake.llm.spread import free_name, salted

AVERAGE = 3  # lines between boundaries, on average
LEAST = 2  # lines that a chunk must have to be removed
_TURN, _MODULUS = 31, 1 << 40


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")


def _with_chunks(df: DataFrame, text: Column, average: int) -> DataFrame:
    """Adds _chunks, the text's chunks in order, null for null. A chunk is a string of its lines, each after a dot, joined
    by newlines; so two newlines in a row stand between chunks and nowhere else, and one split finds them in linear
    time, however many there are. Each array is a column of its own on the way, so that it's made once."""
    df = df.withColumn("_lines", F.split(text, "\n", -1)).withColumn("_hashes", F.transform("_lines", _line_hash))
    before = F.concat(F.array(F.lit(0).cast("long")), F.slice("_hashes", F.lit(1), F.size("_hashes") - 1))
    df = df.withColumn("_ends", F.zip_with("_hashes", before, lambda h, b: (h * _TURN + b) % _MODULUS % average == 0))
    ended = F.zip_with("_lines", "_ends", lambda line, end: F.concat(F.lit("."), line, F.when(end, "\n\n").otherwise("\n")))
    df = df.withColumn("_chunks", F.split(F.rtrim(F.array_join(ended, ""), F.lit("\n")), "\n\n", -1))
    return df.drop("_lines", "_hashes", "_ends")


def _size(chunk: Column) -> Column:
    """Lines of a chunk."""
    return F.length(chunk) - F.length(F.replace(chunk, F.lit("\n"), F.lit(""))) + 1


def _text(chunks: Column) -> Column:
    joined = F.replace(F.concat(F.lit("\n"), F.array_join(chunks, "\n")), F.lit("\n."), F.lit("\n"))
    return F.substring(joined, F.lit(2), F.length(joined))


def _hash(chunk: Column) -> Column:
    return F.unhex(F.md5(chunk.cast("binary")))


def remove_repeated_chunks(docs: DataFrame, average: int = AVERAGE, least: int = LEAST, owner: str = "op1", runs: bool = False) -> DataFrame:
    """Removes the repeated chunks of ``docs`` (doc_id, text); other columns are kept as they are.

    Adds removed_chunks and removed_lines (with underscores after them where ``docs`` has such columns), and returns a row
    for each row. Lines are what newlines separate. A text all of whose lines go becomes empty; null stays null. Rows
    without doc_id come after all others, so their chunks go if any other row has them, and among themselves by nothing
    but their place, so that they keep their own. Rows that share a doc_id and a place share an occurrence: copies of one
    row keep or lose the same lines. With ``runs``, a repeated chunk of fewer than ``least`` lines goes too where it stands
    next to another repeated chunk. An empty table gives no rows.

    A chunk that very many rows have is dealt out over tasks; only its hash is broadcast.
    """
    scratch = Scratch(docs.sparkSession, owner)
    fields = docs.columns
    order = lambda: F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "start")
    # Rows that share a doc_id, or have none, are told apart by their texts.
    content = F.xxhash64("text")
    cut = _with_chunks(docs.select("doc_id", "text", content.alias("content")), F.col("text"), average)
    exploded = cut.select("doc_id", "content", F.posexplode("_chunks").alias("start", "piece"))
    pieces = exploded if runs else exploded.where(_size(F.col("piece")) >= least)
    hashed = pieces.withColumn("hash", _hash(F.col("piece")))

    seen = scratch.table("seen", hashed.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1"))
    many = seen.agg(F.sum("n")).first()[0] or 0
    # One plan at every size, here and where texts are fetched: a broadcast would be right for small tables only.
    dealt, known = salted(hashed, seen, {"hash": "hash"}, "n", many, F.xxhash64("doc_id", "content", "start"))
    copies = scratch.table("copies", dealt.join(known.drop("n").hint("merge"), ["hash", "_salt"]))
    first = copies.groupBy("hash", "piece").agg(F.min(order()).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # The first occurrence goes to every salt of its hash.
    later = copies.join(first.join(known.select("hash", "_salt"), "hash"), ["hash", "piece", "_salt"]).where(order() != F.col("first"))
    gone = later.groupBy("doc_id", "content").agg(F.array_sort(F.collect_set(F.struct("start", "hash"))).alias("gone")).withColumnsRenamed({"doc_id": "_gone_id", "content": "_gone_content"})

    own = {name: f"_own_{k}" for k, name in enumerate(fields)}
    own |= {"doc_id": "_id", "text": "_text"}
    flat = docs.select(*[F.col(f"`{name}`").alias(own[name]) for name in fields], content.alias("_content"))
    joined = flat.join(gone.hint("merge"), F.col("_id").eqNullSafe(F.col("_gone_id")) & (F.col("_content") == F.col("_gone_content")), "left")
    # By place the hash of the chunk that is gone there, or null: looked up in constant time.
    place = lambda k: F.coalesce(F.get("gone", k)["start"], F.lit(-1))
    gaps = F.transform("gone", lambda g, k: F.concat(F.array_repeat(F.lit(None).cast("binary"), g["start"] - F.when(k > 0, place(k - 1)).otherwise(-1) - 1), F.array(g["hash"])))
    marked = _with_chunks(joined.withColumn("_at", F.flatten(gaps)), F.when(F.col("gone").isNotNull(), F.col("_text")), average)
    marked = marked.withColumn("_flags", F.transform("_chunks", lambda c, k: F.coalesce(F.get("_at", k) == _hash(c), F.lit(False))))
    if runs:
        beside = lambda k: F.coalesce(F.when(k > 0, F.get("_flags", k - 1)), F.lit(False)) | F.coalesce(F.get("_flags", k + 1), F.lit(False))
        marked = marked.withColumn("_flags", F.transform("_chunks", lambda c, k: F.get("_flags", k) & ((_size(c) >= least) | beside(k))))
    kept = _text(F.filter("_chunks", lambda c, k: ~F.get("_flags", k)))
    lost = F.filter("_chunks", lambda c, k: F.get("_flags", k))
    made = F.struct(
        F.when(F.col("_chunks").isNotNull(), kept).otherwise(F.col("_text")).alias("text"),
        F.coalesce(F.size(lost), F.lit(0)).cast("long").alias("chunks"),
        F.coalesce(F.aggregate(F.transform(lost, _size), F.lit(0), lambda a, b: a + b), F.lit(0)).cast("long").alias("lines"),
    )
    # Generated rather than projected: conditions on the result would else be pushed down and repeat all of the above.
    out = marked.select(*[own[name] for name in fields if name != "text"], F.explode(F.array(made)).alias("_made"))
    out = out.select(*[F.col("_made.text" if name == "text" else own[name]).alias(name) for name in fields], F.col("_made.chunks").alias(free_name(fields, "removed_chunks")), F.col("_made.lines").alias(free_name(fields, "removed_lines")))
    return out


#: The same in DuckDB's SQL, for a table documents without repeated or null doc_id.
SQL = f"""
with lined as (select doc_id, string_split(text, chr(10)) as lines from documents where text is not null),
hashed as (select *, list_transform(lines, lambda l: ('0x' || substr(md5(l), 1, 8))::bigint) as hs from lined),
rolled as (select *, list_transform(range(1, len(lines) + 1), lambda i: (hs[i] * {_TURN} + coalesce(hs[i - 1], 0)) % {_MODULUS}) as rs from hashed),
ended as (select *, list_filter(range(1, len(lines) + 1), lambda i: rs[i] % {AVERAGE} = 0 or i = len(lines)) as ends from rolled),
cut as (select doc_id, lines, unnest(list_transform(range(1, len(ends) + 1), lambda k: {{'a': coalesce(ends[k - 1], 0), 'b': ends[k]}})) as c from ended),
chunks as (select doc_id, c.a as start, c.b - c.a as size, array_to_string(lines[c.a + 1 : c.b], chr(10)) as piece from cut),
ranked as (select *, size >= {LEAST} and row_number() over (partition by piece, size >= {LEAST} order by doc_id, start) > 1 as bad from chunks),
whole as (
  select doc_id, string_agg(piece, chr(10) order by start) filter (where not bad) as kept, count(*) filter (where bad) as chunks, sum(size) filter (where bad) as lines
  from ranked group by doc_id)
select d.doc_id, case when d.text is null then null else coalesce(w.kept, '') end as text,
  coalesce(w.chunks, 0)::bigint as removed_chunks, coalesce(w.lines, 0)::bigint as removed_lines
from documents d left join whole w using (doc_id)
"""

"""Search tables kept up by batches of media items, instead of being built anew.

Every commit makes a *version*. What a batch adds is a *part* named by that version: its segments, index entries,
vectors and a row per media item. Postings are made once per batch and kept as entries only; those of removed media
items are made again from their segments. What a batch removes or replaces is a table of *marks*, the media item and
the part that held it, and negative word counts of that part. A version's manifest names the live parts, the versions
whose marks count, and the corpus figures; it is one file and written last, so readers see a version whole or
not at all, and a commit that was cut off is done again under the same number. A media item lives in one part at a
time. Word counts are whole numbers, so the merged statistics equal those of an index built at once.

One writer at a time: a second one fails on the manifest that is already there. All batches need the same columns;
``media_id`` is never null.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from reelgrid.operators.lexical import TASK_ENTRIES, LexicalIndex, build_postings
from reelgrid.operators.packed import PACKED, pack_entries, pack_postings, range_bounds, unpack
from reelgrid.schemas import BM25_EPSILON, VECTORS
from reelgrid.spreading import fits, remove, tasks_for

FANIN = 4  # parts of about one size that are merged into one
DEAD_SHARE = 0.25  # a part with more dead documents than this is written again
SENT_MARKS = 10_000  # most marked media items that become a filter of a scan
SENT_FILES = 1_000  # most files of segments that are read one by one
SAMPLE_DOCS = 2_000  # documents from which the ranges of a part's entries are taken, about
SAMPLE_ENTRIES = 200_000  # entries of them that are collected, about
MANIFEST = (
    "version bigint, parts array<struct<part: bigint, docs: bigint, dead: bigint, vectors: boolean>>, "
    "marks array<bigint>, n_docs bigint, n_words bigint, mean_idf double, applied map<string, bigint>"
)
MEDIA = "media_id string, n_segments bigint, n_docs bigint, n_words bigint, files array<string>"
PART_TABLES = ("segments", "runs", "entries", "media", "vectors", "postings")  # the last in indexes of earlier code only


class Index(NamedTuple):
    """Live rows of one version: segments, the lexical index, vectors of all modalities."""

    version: int
    segments: DataFrame
    lexical: LexicalIndex
    vectors: DataFrame


def _folder(spark: SparkSession, path: str) -> tuple[Any, Any]:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the subfolders ``name=number``."""
    files, where = _folder(spark, path)
    if not files.exists(where):
        return []
    names = [status.getPath().getName() for status in files.listStatus(where)]
    return sorted(int(name.split("=")[1]) for name in names if "=" in name)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Versions that were committed whole and are still kept."""
    files, _ = _folder(spark, path)
    whole = lambda v: files.exists(_folder(spark, f"{path}/versions/v={v}/_SUCCESS")[1])
    return [v for v in _numbers(spark, f"{path}/versions") if whole(v)]


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict[str, Any]:
    """The figures of a version, by default the last; version 0 is an index without any part."""
    known = versions(spark, path)
    if version is None:
        version = known[-1] if known else 0
    if version not in known:
        if version:
            raise ValueError(f"no version {version} in {path}")
        return {"version": 0, "parts": [], "marks": [], "n_docs": 0, "n_words": 0, "mean_idf": None, "applied": {}}
    return spark.read.schema(MANIFEST).parquet(f"{path}/versions/v={version}").first().asDict(recursive=True)


def _parts(state: dict[str, Any]) -> list[int]:
    return [p["part"] for p in state["parts"]]


def _marks(spark: SparkSession, path: str, state: dict[str, Any]) -> DataFrame | None:
    """``(media_id, part)`` of what is dead in the live parts; None where nothing is."""
    if not state["marks"]:
        return None
    gone = spark.read.parquet(*[f"{path}/gone/by={v}" for v in state["marks"]])
    return _sent(gone.where(F.col("part").isin(_parts(state))))


def _sent(gone: DataFrame) -> DataFrame:
    """Marks that are few enough go to every task, so that what they are looked up for is not shuffled."""
    return F.broadcast(gone) if fits(gone) else gone


def _read(spark: SparkSession, path: str, table: str, parts: list[int], schema: str | None = None) -> DataFrame:
    reader = spark.read.option("basePath", f"{path}/{table}")
    if schema is not None:
        reader = reader.schema(schema)
    held = reader.parquet(*[f"{path}/{table}/part={p}" for p in parts])
    return held.withColumn("part", F.col("part").cast("bigint"))


def _live(spark: SparkSession, path: str, table: str, state: dict[str, Any], parts: list[int] | None = None) -> DataFrame:
    """Rows of the live parts (or some of them) whose media item is not marked there, with their ``part``."""
    held = _read(spark, path, table, _parts(state) if parts is None else parts)
    gone = _marks(spark, path, state)
    return held if gone is None else held.join(gone, ["media_id", "part"], "left_anti")


def _live_vectors(spark: SparkSession, path: str, state: dict[str, Any], parts: list[int] | None = None) -> DataFrame | None:
    wanted = [p["part"] for p in state["parts"] if p["vectors"] and (parts is None or p["part"] in parts)]
    if not wanted:
        return None
    held = _read(spark, path, "vectors", wanted, _vector_ddl(spark, path, state) + ", part bigint")
    gone = _marks(spark, path, state)
    return held if gone is None else held.join(gone, ["media_id", "part"], "left_anti")


def _vector_ddl(spark: SparkSession, path: str, state: dict[str, Any]) -> str:
    """Vectors know a segment by the type its id has in the entries."""
    kind = _read(spark, path, "entries", _parts(state)[:1]).schema["segment_id"].dataType.simpleString()
    rest = [f"{f.name} {f.dataType.simpleString()}" for f in VECTORS.fields if f.name != "segment_id"]
    return ", ".join(["media_id string", f"segment_id {kind}", *rest])


def _words(spark: SparkSession, path: str, state: dict[str, Any]) -> DataFrame:
    """``(token, df)`` over the live documents: counts of the parts less those of what was marked in them."""
    folders = [f"{path}/words/by={v}" for v in sorted({*_parts(state), *state["marks"]})]
    counts = spark.read.schema("part bigint, token string, n bigint").parquet(*folders)
    counts = counts.where(F.col("part").isin(_parts(state)))
    return counts.groupBy("token").agg(F.sum("n").alias("df")).where("df > 0")


def _raw_idf(n_docs: int) -> Column:
    return F.log(F.lit(n_docs) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)


def _empty_index(spark: SparkSession) -> Index:
    entries = spark.createDataFrame([], "token string, segment_id string, tf int, doc_len int")
    idf = spark.createDataFrame([], "token string, df bigint, idf double")
    corpus = spark.createDataFrame([(0, None)], "n_docs bigint, avg_len double")
    segments = spark.createDataFrame([], "media_id string, segment_id string, text string")
    return Index(0, segments, LexicalIndex(entries, idf, corpus), spark.createDataFrame([], VECTORS))


def read_index(spark: SparkSession, path: str, version: int | None = None) -> Index:
    """The live rows of a version, by default the last, as the searches take them.

    A filter on words reaches the scans of entries and word counts through the marks and the merge of counts.
    """
    state = manifest(spark, path, version)
    if not state["parts"]:
        return _empty_index(spark)
    mean = state["mean_idf"] if state["mean_idf"] is not None else 0.0
    raw = _words(spark, path, state).withColumn("raw", _raw_idf(state["n_docs"]))
    idf = raw.select("token", "df", F.when(F.col("raw") < 0, F.lit(mean * BM25_EPSILON)).otherwise(F.col("raw")).alias("idf"))
    length = state["n_words"] / state["n_docs"] if state["n_docs"] else None
    corpus = spark.createDataFrame([(state["n_docs"], length)], "n_docs bigint, avg_len double")
    entries = _live(spark, path, "entries", state).select("token", "segment_id", "tf", "doc_len")
    vectors = _live_vectors(spark, path, state)
    vectors = spark.createDataFrame([], VECTORS) if vectors is None else vectors.select(*VECTORS.names)
    segments = _live(spark, path, "segments", state).drop("part")
    return Index(state["version"], segments, LexicalIndex(entries, idf, corpus), vectors)


def pending(media: DataFrame, path: str) -> DataFrame:
    """Media items that the last version does not hold; reads one row per media item, no segment."""
    spark = media.sparkSession
    state = manifest(spark, path)
    if not state["parts"]:
        return media
    return media.join(_live(spark, path, "media", state).select("media_id"), "media_id", "left_anti")


def _write(df: DataFrame, path: str, mode: str = "overwrite", **options: str) -> None:
    df.write.mode(mode).option("compression", "zstd").options(**options).parquet(path)


def _postings(segments: DataFrame) -> DataFrame:
    keyed = segments.select(F.struct("media_id", "segment_id").alias("_key"), "text")
    return build_postings(keyed, "_key").select("segment_id.*", "doc_len", "terms")


def _write_entries(path: str, part: int, packed: DataFrame, parts: int) -> None:
    kind = packed.sparkSession.read.parquet(f"{path}/segments/part={part}").schema["segment_id"].dataType.simpleString()
    # ids of too many documents for a dictionary are stored as differences, which only this version does
    _write(unpack(packed, parts, kind), f"{path}/entries/part={part}", **{"parquet.writer.version": "PARQUET_2_0"})


def _index_segments(path: str, part: int, kept: DataFrame) -> DataFrame:
    """Write the entries of a part's segments; ``(media_id, doc_len)`` per document. Texts are cut into words once."""
    spark = kept.sparkSession
    share = min(1.0, SAMPLE_DOCS / max(kept.count(), 1))
    runs = f"{path}/runs/part={part}"
    _write(_postings(kept if share == 1.0 else kept.sample(share, 0)), f"{runs}/of=sample")
    few = spark.read.parquet(f"{runs}/of=sample")
    n = few.agg(F.sum(F.size("terms")).alias("n")).first()["n"] or 0
    sample = few.select("media_id", "segment_id", F.inline_outer("terms")).where("token is not null")
    parts = tasks_for(spark, int(n / share), TASK_ENTRIES)
    bounds = range_bounds(sample.sample(min(1.0, SAMPLE_ENTRIES / max(n, 1)), 0), parts)
    pack_postings(_postings(kept), bounds).write.mode("overwrite").parquet(f"{runs}/of=all")
    packed = spark.read.schema(PACKED).parquet(f"{runs}/of=all")
    _write_entries(path, part, packed, parts)
    return packed.select(F.inline("lengths"))


def _merge_entries(path: str, part: int, entries: DataFrame, held: DataFrame) -> None:
    """Write what lives of the entries held by other parts as those of a new part."""
    n = held.count()
    parts = tasks_for(entries.sparkSession, n, TASK_ENTRIES)
    bounds = range_bounds(held.sample(min(1.0, SAMPLE_ENTRIES / max(n, 1)), 0), parts)
    _write_entries(path, part, pack_entries(entries, bounds), parts)


def _write_part(path: str, part: int, segments: DataFrame, vectors: DataFrame | None, merged: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> None:
    """All tables of a part; each is read from the one stored before it, so nothing is computed twice.

    What is merged of other parts comes with their live entries and media items, and all entries they hold.
    """
    spark = segments.sparkSession
    _write(segments, f"{path}/segments/part={part}")
    kept = spark.read.parquet(f"{path}/segments/part={part}")
    if merged is None:
        per_document = _index_segments(path, part, kept)
        lengths = per_document.groupBy("media_id").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("doc_len").alias("n_words"))
    else:
        entries, live, held = merged
        _merge_entries(path, part, entries, held)
        lengths = live.select("media_id", "n_docs", "n_words")
    located = kept.select("media_id", F.col("_metadata.file_name").alias("file"))
    per_segment = located.groupBy("media_id").agg(F.count(F.lit(1)).alias("n_segments"), F.collect_set("file").alias("files"))
    media = per_segment.join(lengths, "media_id", "left").fillna(0, ["n_docs", "n_words"])
    _write(media.select("media_id", "n_segments", "n_docs", "n_words", "files"), f"{path}/media/part={part}")
    remove(spark, f"{path}/runs/part={part}")
    if vectors is not None:
        if "media_id" not in vectors.columns:
            vectors = vectors.join(kept.select("segment_id", "media_id"), "segment_id")
        held = vectors.where(F.size("embedding") > 0).select("media_id", *VECTORS.names)
        held.write.mode("overwrite").partitionBy("modality").parquet(f"{path}/vectors/part={part}")


def _segments_of(spark: SparkSession, path: str, gone: DataFrame, parts: list[int]) -> DataFrame:
    """Segments of these parts, from the files that hold marked media items where those are few."""
    media = _read(spark, path, "media", parts, MEDIA + ", part bigint")
    holding = media.join(_sent(gone), ["media_id", "part"], "left_semi").select("part", F.explode_outer("files").alias("file")).distinct()
    files = holding.limit(SENT_FILES + 1).collect()
    if len(files) > SENT_FILES or any(r["file"] is None for r in files):
        return _read(spark, path, "segments", parts)
    held = spark.read.option("basePath", f"{path}/segments").parquet(*[f"{path}/segments/part={r['part']}/{r['file']}" for r in files])
    return held.withColumn("part", F.col("part").cast("bigint"))


def _mark(path: str, version: int, state: dict[str, Any], media: DataFrame) -> bool:
    """Mark the live ones of these media items as dead and store their words' counts; False if none is live."""
    spark = media.sparkSession
    live = _live(spark, path, "media", state).select("media_id", "part")
    live.join(media.select("media_id").distinct(), "media_id", "left_semi").write.mode("overwrite").parquet(f"{path}/gone/by={version}")
    gone = spark.read.parquet(f"{path}/gone/by={version}")
    some = gone.limit(SENT_MARKS + 1).collect()  # bounded; few ids prune row groups where segments came in their order
    if not some:
        return False
    few = len(some) <= SENT_MARKS
    held = _segments_of(spark, path, gone, sorted({r["part"] for r in some}) if few else _parts(state))
    if few:
        held = held.where(F.col("media_id").isin([r["media_id"] for r in some]))
    dead = build_postings(held.join(_sent(gone), ["media_id", "part"], "left_semi"), "part")
    tokens = dead.select(F.col("segment_id").alias("part"), F.explode_outer("terms.token").alias("token")).where("token is not null")
    _write(tokens.groupBy("part", "token").agg((-F.count(F.lit(1))).alias("n")), f"{path}/words/by={version}", "append")
    return True


def _publish(spark: SparkSession, path: str, state: dict[str, Any]) -> int:
    """Count the corpus figures of a version and write its manifest, the last file of a commit."""
    if state["parts"]:
        held = {p["part"]: p for p in state["parts"]}
        media = _read(spark, path, "media", list(held)).groupBy("part").agg(F.sum("n_docs").alias("docs"))
        docs = {r["part"]: r["docs"] for r in media.collect()}  # one row per live part
        live = _live(spark, path, "media", state).groupBy("part").agg(F.sum("n_docs").alias("docs"), F.sum("n_words").alias("words"))
        left = {r["part"]: r for r in live.collect()}
        state["parts"] = [
            p | {"docs": docs.get(n, 0), "dead": docs.get(n, 0) - (left[n]["docs"] if n in left else 0)}
            for n, p in held.items()
            if n in left  # a part without live media items is left out
        ]
        state["n_docs"] = sum(r["docs"] for r in left.values())
        state["n_words"] = sum(r["words"] for r in left.values())
    oldest = min(_parts(state), default=state["version"])
    state["marks"] = [v for v in state["marks"] if v > oldest]
    if state["parts"]:
        state["mean_idf"] = _words(spark, path, state).agg(F.avg(_raw_idf(state["n_docs"]))).first()[0]
    else:
        state |= {"marks": [], "n_docs": 0, "n_words": 0, "mean_idf": None}
    row = spark.createDataFrame([state], MANIFEST).coalesce(1)
    row.write.mode("errorifexists").parquet(f"{path}/versions/v={state['version']}")
    return state["version"]


def _next(spark: SparkSession, path: str) -> dict[str, Any]:
    """The state a new version starts from; what a commit under its number had left behind is deleted."""
    state = manifest(spark, path)
    state["version"] += 1
    for folder in ("words/by", "gone/by", "versions/v", *[f"{t}/part" for t in PART_TABLES]):
        files, where = _folder(spark, f"{path}/{folder}={state['version']}")
        files.delete(where, True)
    return state


def commit(
    spark: SparkSession,
    path: str,
    segments: DataFrame | None = None,
    vectors: DataFrame | None = None,
    removed: DataFrame | None = None,
    source: str | None = None,
    batch: int | None = None,
) -> int:
    """Add segments ``(media_id, segment_id, text, ...)`` with their vectors, remove media items; the new version.

    Media items of the batch that the index already holds are replaced whole. ``segment_id`` is the segment's unique
    key. The work grows with the batch, the files with segments of what is replaced and the vocabulary, not with the index.
    A ``batch`` of a ``source`` that was committed before changes nothing.
    """
    state = _next(spark, path)
    if source is not None and batch is not None:
        if state["applied"].get(source, -1) >= batch:
            return state["version"] - 1
        state["applied"] |= {source: batch}
    version, before = state["version"], dict(state)
    added = False
    if segments is not None:
        _write_part(path, version, segments, vectors)
        added = spark.read.parquet(f"{path}/media/part={version}").limit(1).count() > 0
    if added:
        entries = spark.read.parquet(f"{path}/entries/part={version}")
        counts = entries.groupBy("token").agg(F.count(F.lit(1)).alias("n")).select(F.lit(version).cast("bigint").alias("part"), "token", "n")
        _write(counts, f"{path}/words/by={version}", "append")
        state["parts"] = [*state["parts"], {"part": version, "docs": 0, "dead": 0, "vectors": vectors is not None}]
    if before["parts"] and (added or removed is not None):
        names = [removed.select("media_id")] if removed is not None else []
        names += [spark.read.parquet(f"{path}/media/part={version}").select("media_id")] if added else []
        media = names[0] if len(names) == 1 else names[0].unionByName(names[1])
        if _mark(path, version, before, media):
            state["marks"] = [*state["marks"], version]
    return _publish(spark, path, state)


def victims(state: dict[str, Any], fanin: int = FANIN, dead_share: float = DEAD_SHARE) -> list[int]:
    """Parts to write again: ``fanin`` or more of one size class, and those with too many dead documents.

    Size classes are powers of ``fanin``, so a document is merged a number of times that grows with the logarithm
    of the corpus, and a version has at most ``fanin`` parts per class. A negative ``dead_share`` takes all parts.
    """
    if fanin < 2:
        raise ValueError("at least two parts are merged")
    classes: dict[int, list[int]] = {}
    chosen = set()
    for p in state["parts"]:
        size, level = p["docs"] - p["dead"], 0
        while size >= fanin ** (level + 1):
            level += 1
        classes.setdefault(level, []).append(p["part"])
        if p["dead"] > dead_share * p["docs"]:
            chosen.add(p["part"])
    for parts in classes.values():
        if len(parts) >= fanin:
            chosen.update(parts)
    return sorted(chosen)


def compact(spark: SparkSession, path: str, fanin: int = FANIN, dead_share: float = DEAD_SHARE) -> int:
    """Merge parts of one size and drop dead rows from much changed ones; the version stays where nothing is due."""
    due = victims(manifest(spark, path), fanin, dead_share)
    if not due:
        return manifest(spark, path)["version"]
    state = _next(spark, path)
    version = state["version"]
    segments, entries, media = (_live(spark, path, t, state, due).drop("part") for t in ("segments", "entries", "media"))
    vectors = _live_vectors(spark, path, state, due)
    merged = entries, media, _read(spark, path, "entries", due)
    _write_part(path, version, segments, None if vectors is None else vectors.drop("part"), merged)
    entries = spark.read.parquet(f"{path}/entries/part={version}")
    counts = entries.groupBy("token").agg(F.count(F.lit(1)).alias("n")).select(F.lit(version).cast("bigint").alias("part"), "token", "n")
    _write(counts, f"{path}/words/by={version}", "append")
    state["parts"] = [p for p in state["parts"] if p["part"] not in due]
    state["parts"].append({"part": version, "docs": 0, "dead": 0, "vectors": vectors is not None})
    return _publish(spark, path, state)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete all that none of the last ``keep`` versions reads; the number of folders that went."""
    known = versions(spark, path)
    kept = known[-keep:]
    states = [manifest(spark, path, v) for v in kept]
    parts = {p for s in states for p in _parts(s)}
    marks = {v for s in states for v in s["marks"]}
    live = {"versions/v": set(kept), "gone/by": marks, "words/by": parts | marks}
    live |= {f"{table}/part": parts for table in PART_TABLES}
    deleted = 0
    for folder, wanted in live.items():
        table = folder.split("/")[0]
        for number in _numbers(spark, f"{path}/{table}"):
            if known and number <= known[-1] and number not in wanted:
                files, where = _folder(spark, f"{path}/{folder}={number}")
                deleted += files.delete(where, True)
    return deleted


def index_stream(
    media: DataFrame,
    make: Callable[[DataFrame], tuple[DataFrame, DataFrame | None]],
    path: str,
    source: str,
    compact_every: int = 10,
) -> DataStreamWriter:
    """Ingest media items as their rows arrive: each batch's segments and vectors are made and committed once.

    ``make`` turns the batch's media items that the index does not hold into ``(segments, vectors)``. A batch's number
    is in the manifest of its version, so a batch that runs again after a crash adds nothing twice.
    """

    def ingest_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if manifest(spark, path)["applied"].get(source, -1) < batch_id:
            new = pending(batch.dropDuplicates(["media_id"]), path)
            segments, vectors = make(new)
            commit(spark, path, segments, vectors, source=source, batch=batch_id)
        if batch_id and batch_id % compact_every == 0:
            compact(spark, path)

    return media.writeStream.foreachBatch(ingest_batch)

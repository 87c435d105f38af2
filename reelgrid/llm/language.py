"""Language identification by Bayesian evidence fusion.

Four kinds of evidence are added as log-probabilities per language: the text's hashed byte trigrams
under a model of labelled texts, the language that the markup declares, the one that the address
names, and a prior of the host. Host priors are smoothed hierarchically: a host's counts lean on those
of its address suffix, which lean on all. The counts are sums of text posteriors by grouped
aggregation, and a row's own share is taken out before it is judged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid.llm.common import boxed, slices, stored
from reelgrid.llm.lines import bind

LANGUAGES = ("de", "en", "es", "fr")
BUCKETS = 1 << 14
TEXT_WEIGHT = 60  # trigrams of one text overlap: its mean counts as so many independent ones, at most
TRUST = 0.9  # how often a declared language is the right one
LEAN = 10.0  # rows that a prior counts as
ACCEPT = 0.5
NONE = 0.01  # prior of a text in none of the languages

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def trigrams(text: str) -> np.ndarray:
    """Hashed byte trigrams of the letters, A-Z in lower case, others than letters as white space."""
    folded = b" ".join(text.encode().translate(_FOLD).split())
    if not folded:
        return np.zeros(0, np.uint32)
    raw = np.frombuffer(b" " + folded + b" ", np.uint8).astype(np.uint32)
    mixed = (raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]) * np.uint32(2654435761)
    return mixed >> np.uint32(32 - BUCKETS.bit_length() + 1)


def train(docs: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> np.ndarray:
    """Log-probabilities ``[bucket, language]`` from all whole texts labelled with one of ``languages``."""
    number = {x: i for i, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS * len(languages), np.int64)
        for whole in batches:
            for batch in slices(whole, "text"):
                for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                    np.add(counts, np.bincount(trigrams(text) * len(languages) + number[lang], minlength=len(counts)), out=counts)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at])], ["cell", "n"])

    labelled = docs.where(F.col("lang").isin(*languages) & F.col("text").isNotNull()).select("text", "lang")
    cells = labelled.mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.full(BUCKETS * len(languages), 0.5)
    table[cells["cell"].to_numpy()] += cells["n"].to_numpy()
    table = table.reshape(BUCKETS, len(languages))
    return np.log(table / table.sum(axis=0))


def text_evidence(items: DataFrame, model: np.ndarray, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """``items`` without ``text``, with ``grams`` (trigrams of letters) and ``texts``, one log-likelihood per language."""
    sent = items.sparkSession.sparkContext.broadcast(model.astype(np.float32))
    kept = [c for c in items.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = sent.value
        for whole in batches:
            for batch in slices(whole, "text"):
                grams, found = [], []
                for text in batch.column("text").to_pylist():
                    codes = trigrams(text or "")
                    grams.append(len(codes))
                    mean = logs[codes].mean(axis=0, dtype=np.float64) if len(codes) else np.zeros(len(languages))
                    found.append((mean * min(len(codes), TEXT_WEIGHT)).tolist())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in kept), pa.array(grams, pa.int64()), pa.array(found, pa.list_(pa.float64()))],
                    [*kept, "grams", "texts"],
                )

    fields = ", ".join(f"{c} {items.schema[c].dataType.simpleString()}" for c in kept)
    return items.mapInArrow(run, f"{fields}, grams bigint, texts array<double>")


def _softmax(logs: Column) -> Column:
    """Of an array of log-weights the shares, in the same order."""

    def shares(exps: Column) -> Column:
        return bind(F.aggregate(exps, F.lit(0.0), lambda a, b: a + b), lambda total: F.transform(exps, lambda e: e / total))

    return bind(F.array_max(logs), lambda top: bind(F.transform(logs, lambda x: F.exp(x - top)), shares))


def identify(items: DataFrame, model: np.ndarray, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """Judge ``items``: any key columns, ``text, declared, named, suffix, host``.

    Returns the key columns with ``text_language, language, probability, accepted``. ``declared`` is the
    markup's language, ``named`` the one in the address; null or unknown ones say nothing. A null suffix
    or host is a suffix or host of its own. A text without letters has no language and is not accepted, nor
    is one that is likelier in none of the languages; ties go to the first language. Rows are judged one by one, also repeated ones.
    """
    keys = [c for c in items.columns if c not in ("text", "declared", "named", "suffix", "host")]
    shaped = items.select(
        *keys, "text", "declared", "named",
        F.coalesce("suffix", F.lit("")).alias("suffix"), F.coalesce("host", F.lit("")).alias("host"),
    )
    judged = text_evidence(shaped, model, languages)
    span = range(len(languages))
    blank = F.least("grams", F.lit(TEXT_WEIGHT)) * float(-np.log(BUCKETS)) + float(np.log(NONE))
    judged = judged.withColumn("_logs", F.array(*[F.col("texts")[i] - float(np.log(len(languages))) for i in span], blank))
    judged = judged.withColumn("_posts", _softmax(F.col("_logs")))
    own = {f"_t{i}": F.when(F.col("grams") > 0, F.col("_posts")[i]).otherwise(0.0) for i in span}
    judged = stored(judged.withColumns(own).drop("_logs", "_posts"), "evidence")
    hosts = judged.groupBy("suffix", "host").agg(*[F.sum(f"_t{i}").alias(f"_h{i}") for i in span])
    hosts = stored(hosts, "hosts")
    suffixes = hosts.groupBy("suffix").agg(*[F.sum(f"_h{i}").alias(f"_s{i}") for i in span])
    everything = suffixes.agg(*[F.coalesce(F.sum(f"_s{i}"), F.lit(0.0)) for i in span]).first()
    total = sum(everything) + len(languages)
    world = [(everything[i] + 1) / total for i in span]
    joined = judged.join(hosts.join(suffixes, "suffix"), ["suffix", "host"])

    def lean(level: str, above: list[Column]) -> list[Column]:
        counts = [F.greatest(F.col(f"_{level}{i}") - F.col(f"_t{i}"), F.lit(0.0)) for i in span]
        sums = sum(counts[1:], counts[0])
        return [(counts[i] + LEAN * above[i]) / (sums + LEAN) for i in span]

    above = lean("s", [F.lit(w) for w in world])
    joined = joined.withColumns({f"_a{i}": above[i] for i in span})
    priors = lean("h", [F.col(f"_a{i}") for i in span])

    def said(column: str, i: int) -> Column:
        told = F.lower(F.substring_index(column, "-", 1))
        wrong = (1 - TRUST) / max(1, len(languages) - 1)
        return (
            F.when(told == languages[i], float(np.log(TRUST)))
            .when(told.isin(*languages), float(np.log(wrong)))
            .otherwise(0.0)
        )

    def heard(column: str) -> Column:
        """Of a text in none of the languages, any may be told."""
        told = F.lower(F.substring_index(column, "-", 1))
        return F.when(told.isin(*languages), float(-np.log(len(languages)))).otherwise(0.0)

    logs = [F.col("texts")[i] + F.log(priors[i]) + said("declared", i) + said("named", i) for i in span]
    logs.append(blank + heard("declared") + heard("named"))
    joined = joined.select(*keys, "grams", "texts", F.array(*logs).alias("_logs"))
    scored = joined.select(*keys, "grams", "texts", _softmax(F.col("_logs")).alias("_p"))
    scored = scored.withColumn("_known", F.slice("_p", 1, len(languages)))
    best = F.array_max("_known")
    names = F.array(*[F.lit(x) for x in languages])
    chosen = F.get(names, (F.array_position("_known", best) - 1).cast("int"))
    by_text = F.get(names, (F.array_position("texts", F.array_max("texts")) - 1).cast("int"))
    some = F.col("grams") > 0
    return scored.select(
        *keys,
        F.when(some, by_text).alias("text_language"),
        F.when(some & (best >= F.col("_p")[len(languages)]), chosen).alias("language"),
        F.when(some, best).otherwise(0.0).alias("probability"),
        (some & (best >= ACCEPT)).alias("accepted"),
    )


def document_items(docs: DataFrame) -> DataFrame:
    """Documents as items: the source is the host. The label is what is learnt, so it is not evidence."""
    nothing = F.lit(None).cast("string")
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        nothing.alias("declared"),
        nothing.alias("named"),
        nothing.alias("suffix"),
        F.col("source").cast("string").alias("host"),
    )


def page_items(pages: DataFrame) -> DataFrame:
    """Web pages as items: visible text, the root element's language, and what the address tells."""
    bare = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&\w+;", " ")
    host = F.lower(F.try_parse_url("url", F.lit("HOST")))
    return pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.coalesce(bare, F.lit("")).alias("text"),
        F.nullif(F.regexp_extract("html", r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})""", 1), F.lit("")).alias("declared"),
        F.nullif(F.regexp_extract("url", r"(?i)^[a-z]+://[^/]+/([a-z]{2})(?:[-/?#]|$)", 1), F.lit("")).alias("named"),
        F.substring_index(host, ".", -1).alias("suffix"),
        host.alias("host"),
    )


def keep_identified(docs: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """``docs`` without those whose language is not accepted; all columns stay, whatever their names."""
    tagged = document_items(docs).withColumn("version", F.xxhash64("text"))
    judged = identify(tagged, train(docs, languages), languages)
    refused = judged.where("not accepted").select(F.col("doc_id").alias("told"), F.col("version").alias("mark")).distinct()
    kept = boxed(docs).withColumnRenamed("mark", "own")
    same = (F.col("own") == F.col("mark")) & F.col("id").eqNullSafe(F.col("told"))
    return kept.join(stored(refused, "refused"), same, "left_anti").select("row.*")

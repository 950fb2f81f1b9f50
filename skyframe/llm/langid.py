"""Language identification by compression: the language whose text helps most to shorten a text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import kept_apart, small_arrow_batches

LETTER = regex.compile(r"\p{L}")
#: What a dictionary saves has a bound, so longer texts are compressed in equal blocks of this many bytes at most.
BLOCK = 8192


def held_out(id_col: Column, modulus: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % modulus == fold, F.lit(False))


def train(
    labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", samples: int = 64, sample_bytes: int = 2048, pieces: int = 8, max_langs: int = 1000
) -> dict[str, bytes]:
    """A raw-content dictionary for each language: `samples` texts at most, of about `sample_bytes` each. A longer text gives `pieces` pieces,
    spread evenly from its start to its end.

    These bound the sample, 128 KB a language. A text's hash picks one of `samples` cells of its language and in each cell
    the least hash wins, so copies count once and reruns agree. Rows with null text or language, or an empty text, teach nothing.
    Only hashes are aggregated over all rows; the chosen texts are then looked up by them.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    hashed = rows.withColumn("h", F.xxhash64("text"))
    picked = hashed.groupBy("lang", F.pmod("h", F.lit(samples)).alias("cell")).agg(F.min("h").alias("h")).limit(max_langs * samples + 1).collect()
    if len(picked) > max_langs * samples:
        raise ValueError(f"more than {max_langs} languages")
    if not picked:
        return {}
    spark = labelled.sparkSession
    keys = spark.createDataFrame([(r["lang"], r["h"]) for r in picked], "lang string, h long").coalesce(1)
    found = hashed.join(F.broadcast(keys), ["lang", "h"]).select("lang", "h", spread(F.col("text"), sample_bytes, pieces).alias("text"))
    found = found.groupBy("lang", "h").agg(F.min("text").alias("text")).collect()
    out: dict[str, bytes] = {}
    for r in sorted(found, key=lambda r: (r["lang"], r["h"])):
        out[r["lang"]] = out.get(r["lang"], b"") + r["text"].lower().encode() + b"\n"
    return out


def spread(text: Column, most: int, pieces: int) -> Column:
    """A text of at most `most` bytes whole, a longer one as `pieces` pieces at even distances, the last at its end, of `most` bytes together."""
    n, size = F.length(text), F.octet_length(text)
    # characters of a piece: as many as have most / pieces bytes on average
    long_ = F.greatest(F.floor(n * most / (size * pieces)).cast("int"), F.lit(1))
    at = lambda i: (F.floor((n - long_) * i / max(pieces - 1, 1)) + 1).cast("int")
    return F.when(size <= most, text).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), lambda i: F.substring(text, at(i), long_)), "\n"))


def blocks(raw: bytes) -> list[bytes]:
    n = -(-len(raw) // BLOCK)
    return [raw[len(raw) * i // n : len(raw) * (i + 1) // n] for i in range(n)]


def predict(docs: DataFrame, model: dict[str, bytes], *, text_col: str = "text", level: int = 9, margin: float = 0.01, prefix: str = "") -> DataFrame:
    """Adds lang_pred, score and rejected, their names after `prefix`, to all columns of docs; columns of docs with these names get an underscore behind them.

    Each whole text, in lower case, is compressed once with each language's dictionary, block by block, so that a long text has the margin
    that its parts have; the smallest sum names the language, ties go to the first name. score is what the best sum saves against the second, relative to it. rejected: score under `margin`,
    or lang_pred is `und`: the text is null, empty or without a letter, or nothing was learned. With one language score is 1.
    Rows that repeat have one result each.
    """
    small_arrow_batches(docs.sparkSession)
    added = [prefix + x for x in ("lang_pred", "score", "rejected")]
    at = docs.columns.index(text_col)
    docs = kept_apart(docs, added)
    names, out_names = sorted(model), docs.columns + added
    out_schema = docs.select("*", *[F.lit(x).alias(a) for x, a in zip(("", 0.0, True), added, strict=True)]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = []
        p = zstandard.ZstdCompressionParameters.from_level(level, min_match=3)
        for name in names:
            d = zstandard.ZstdCompressionDict(model[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=p)
            coders.append(zstandard.ZstdCompressor(dict_data=d, compression_params=p))
        for b in batches:
            langs, scores = [], []
            for text in b.column(at):
                t = text.as_py()
                if not names or not t or not LETTER.search(t):
                    langs.append("und")
                    scores.append(0.0)
                    continue
                parts = blocks(t.lower().encode())
                size = sorted((sum(len(c.compress(x)) for x in parts), n) for c, n in zip(coders, names, strict=True))
                langs.append(size[0][1])
                scores.append(1.0 - size[0][0] / size[1][0] if len(size) > 1 else 1.0)
            rejected = [n == "und" or s < margin for n, s in zip(langs, scores, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=out_names)

    return docs.mapInArrow(run, out_schema)


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")

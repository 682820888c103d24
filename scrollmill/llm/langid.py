"""Language ID by compression: per-language zstandard raw-content dictionaries.

A text is folded to lower-case letters and single spaces, cut into blocks, and every block is
compressed with each language's dictionary; the language with the smallest total wins. A text whose
two smallest totals lie within `MIN_MARGIN` of each other is rejected.

Learning takes a bounded sample: `PIECES` pieces of `PIECE` characters for each language, chosen
by hash from the rows that may be learned from. The sum of all dictionaries stays under `ALL_BYTES`,
however many languages there are.

Rows: a null text, or one without a letter, is `und` with score 0 and rejected; a null lang is not
learned from; a null doc_id counts as learnable; repeated rows weigh once; ties go to the first language
in order. With nothing to learn from every text is `und`. Other columns pass through; input
columns named like the results are replaced.
"""

from __future__ import annotations

import re

import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrollmill.llm.common import crc_bucket, table, with_text_columns

PIECES, PIECE, ALL_BYTES = 1200, 200, 32_000_000
LEVEL, BLOCK = 4, 1000
MIN_MARGIN = 0.01
NOT_LETTERS = re.compile(r"[\W\d_]+")


def fold(text: str | None) -> str:
    return NOT_LETTERS.sub(" ", text).strip().lower() if text else ""


def learnable(docs: DataFrame) -> DataFrame:
    """Rows whose crc32(doc_id as text) mod 3 is not 1."""
    return docs.filter(crc_bucket("doc_id", 3) != 1)


def dictionaries(rows: DataFrame, pieces: int = PIECES, piece: int = PIECE) -> dict[str, bytes]:
    """Raw-content dictionaries from (text, lang); one count per language and a bounded sample reach the driver."""
    rows = rows.filter("text is not null and lang is not null").select("lang", "text", F.xxhash64("text").alias("h"))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.countDistinct("h").alias("n")).collect()}  # texts, since copies weigh once
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 3.0 * pieces / n))])
    start = F.pmod(F.xxhash64("h"), F.greatest(F.length("text") - piece, F.lit(1))) + 1
    drawn = rows.filter(F.pmod("h", F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)).select("lang", "h", F.substring("text", start.cast("int"), F.lit(piece)).alias("piece"))
    once = drawn.groupBy("lang", "h").agg(F.min("piece").alias("piece"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("h"), "piece"))).filter(F.col("rank") <= pieces)
    found: dict[str, list] = {lang: [] for lang in sorted(counts)}
    for r in ranked.collect():
        found[r.lang].append((r["rank"], fold(r.piece)))
    most = ALL_BYTES // len(found)
    return {lang: " ".join(p for _, p in sorted(own)).encode()[:most] for lang, own in found.items()}


class Classifier:
    def __init__(self, raw: dict[str, bytes], level: int = LEVEL):
        self.langs = sorted(raw)
        self.press = []
        for lang in self.langs:
            shared = zstandard.ZstdCompressionDict(raw[lang] or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            shared.precompute_compress(level=level)
            self.press.append(zstandard.ZstdCompressor(level=level, dict_data=shared, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def predict(self, text: str | None) -> tuple[str, float, float, bool]:
        """(language, score, margin, rejected)."""
        folded = fold(text)
        # What is left may still be signs that count as word characters, such as fractions.
        if not self.langs or not any(map(str.isalpha, folded)):
            return "und", 0.0, 0.0, True
        blocks = [folded[i : i + BLOCK].encode() for i in range(0, len(folded), BLOCK)]
        sizes = [sum(len(press(b)) for b in blocks) for press in self.press]
        best = min(range(len(sizes)), key=lambda i: (sizes[i], i))
        others = sizes[:best] + sizes[best + 1 :]
        margin = (min(others) - sizes[best]) / min(others) if others else 1.0
        score = 1.0 / (1.0 + sum(2.0 ** -min(60.0, 0.8 * (s - sizes[best])) for s in others))
        return self.langs[best], score, margin, bool(others) and margin < MIN_MARGIN


def with_language(docs: DataFrame, raw: dict[str, bytes]) -> DataFrame:
    """Add lang_pred, score, margin and rejected to `docs`."""
    shared = docs.sparkSession.sparkContext.broadcast(raw)

    def make():
        predict = Classifier(shared.value).predict
        return lambda texts: zip(*map(predict, texts)) if texts else [[], [], [], []]

    return with_text_columns(docs, "text", "lang_pred string, score double, margin double, rejected boolean", make)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    raw = dictionaries(learnable(docs.select("doc_id", "text", "lang")))
    found = with_language(docs.select("doc_id", "text"), raw)
    return found.select("doc_id", (crc_bucket("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def drop_rejected(docs: DataFrame) -> DataFrame:
    """`docs` without the documents that the classifier, learned from them, rejects; the columns stay as they are."""
    raw = dictionaries(learnable(docs.select("doc_id", "text", "lang")))
    spot = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("text"))
    return with_language(spot, raw).filter("not rejected").select("row.*")

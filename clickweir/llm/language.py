"""Language identification by compression.

Every language gets a raw-content zstandard dictionary of its own training text. A text's language is the one whose
dictionary encodes it in the fewest bytes; if the runner-up needs hardly more, as for junk and unlearned languages, it is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clickweir.llm.packs import give_back, slices, text_column, texts_of
from clickweir.llm.rows import free_names

DICTIONARY_BYTES = 64 << 10  # of training text per language
SAMPLE_DOCS = 200  # training documents per language at most, chosen by the MD5 of doc_id
SAMPLE_CHARS = 400  # taken from each of them, from a place chosen by the same hash
LANGUAGES = 200  # more raise: at most LANGUAGES * SAMPLE_DOCS * SAMPLE_CHARS characters come to the driver
LEVEL = 6
SHORT, SHORT_LEVEL = 150, 19  # texts of fewer bytes are encoded at a level that finds every match
BLOCK = 1000  # bytes encoded at a time, so that a long text leans on the dictionary and not on itself
# A text is rejected if the runner-up needs fewer than MARGIN of its bytes on top, where a code of fewer than LEAST bytes
# counts as LEAST, so that short texts need two bytes. Told rightly and rejected: 0.07 % of 1,500 training rows of sf0.1,
# 0.4 % of 10,251 held-out rows of check_s.
MARGIN, LEAST = 0.03, 66


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0


def letters(texts: pa.Array) -> pa.Array:
    """Lower-cased letters; everything between them is one space."""
    return pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}]+", " ")


def learn(docs: DataFrame) -> dict[str, bytes]:
    """Raw-content dictionaries by language from a bounded sample of the rows with lang, text and doc_id.

    The hash of doc_id deals the documents of a language into SAMPLE_DOCS slices; the first of each slice gives a piece
    of SAMPLE_CHARS characters. That is one aggregate with partial results in the tasks, whatever a language's size.
    """
    key = F.md5(F.col("doc_id").cast("string"))
    number = F.conv(F.substring(key, 1, 8), 16, 10).cast("long")
    start = F.pmod(number, F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(1))) + 1
    piece = F.struct(key.alias("key"), F.substr("text", start.cast("int"), F.lit(SAMPLE_CHARS)).alias("text"))
    usable = docs.select(F.col("doc_id"), F.col("lang").cast("string"), F.col("text").cast("string")).dropna()
    firsts = usable.groupBy("lang", F.pmod(number, F.lit(SAMPLE_DOCS)).alias("slice")).agg(F.min(piece).alias("first"))
    rows = firsts.select("lang", "first.key", "first.text").limit(LANGUAGES * SAMPLE_DOCS + 1).collect()
    if len({r["lang"] for r in rows}) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    out = {}
    for language in sorted({r["lang"] for r in rows}):
        texts = [t for _, t in sorted((r["key"], r["text"]) for r in rows if r["lang"] == language)]
        content = " ".join(letters(pa.array(texts)).to_pylist()).encode()[:DICTIONARY_BYTES]
        if content.strip():
            out[language] = content
    return out


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.names, self.coders, self.short = list(dictionaries), [], []
        form = {"write_checksum": False, "write_content_size": False, "write_dict_id": False}
        for content in dictionaries.values():
            words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(level=LEVEL)
            self.coders.append(zstandard.ZstdCompressor(dict_data=words, **form))
            every = zstandard.ZstdCompressionParameters(compression_level=SHORT_LEVEL, **form)
            words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(compression_params=every)
            self.short.append(zstandard.ZstdCompressor(dict_data=words, compression_params=every))

    def predict(self, text: bytes) -> tuple[str, float, float]:
        """For a text of letters(): the language (of ties the first by name), the chance that its code is the right one
        if all are as likely (each byte more is 256 times less likely), and the runner-up's extra share of bytes, of LEAST bytes at least."""
        if not text.strip() or not self.names:
            return "und", 0.0, 0.0
        blocks = [text[a:a + BLOCK] for a in range(0, len(text), BLOCK)]
        coders = self.short if len(text) < SHORT else self.coders
        sizes = sorted((sum([len(coder.compress(b)) for b in blocks]), name) for name, coder in zip(self.names, coders))
        best = sizes[0][0]
        margin = (sizes[1][0] - best) / max(best, LEAST) if len(sizes) > 1 else 1.0
        return sizes[0][1], 1 / sum(256.0 ** max(best - n, -100) for n, _ in sizes), margin


def guess(spark: SparkSession, dictionaries: dict[str, bytes], text: Column) -> Column:
    """Struct of lang_pred, score and margin for a column of texts."""
    shared = spark.sparkContext.broadcast(dictionaries)  # bounded by LANGUAGES * DICTIONARY_BYTES

    def predicted(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = Classifier(shared.value)
        for column in columns:
            batch = pa.RecordBatch.from_arrays([column], ["text"])
            guesses = []
            for some in slices([batch], 0, 4 << 20):
                plain = pa.RecordBatch.from_arrays([letters(text_column(some, 0))], ["text"])
                guesses += [model.predict(t) for t in texts_of(plain, 0)]
            names, scores, margins = zip(*guesses) if guesses else ((), (), ())
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64())],
                                             ["lang_pred", "score", "margin"])
        give_back()

    return F.arrow_udf(predicted, "struct<lang_pred: string, score: double, margin: double>")(text.cast("string"))


def identify(spark: SparkSession, docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """`docs` with lang_pred, score and accepted (columns of these names are replaced), from the whole text alone.

    `und`, score 0 and not accepted: null texts and those without a letter. A text whose margin is below `margin` keeps
    its best guess but is not accepted. Without any dictionary all are `und`.
    """
    name, = free_names(docs, "_guess")
    return (docs.withColumn(name, guess(spark, dictionaries, F.col("text"))).withColumn("lang_pred", F.col(f"{name}.lang_pred"))
            .withColumn("score", F.col(f"{name}.score"))
            .withColumn("accepted", (F.col("lang_pred") != "und") & (F.col(f"{name}.margin") >= margin)).drop(name))


def accepted(spark: SparkSession, docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """The rows of `docs` that identify() accepts."""
    name, = free_names(docs, "_guess")
    found = docs.withColumn(name, guess(spark, dictionaries, F.col("text")))
    return found.where((F.col(f"{name}.lang_pred") != "und") & (F.col(f"{name}.margin") >= margin)).drop(name)

"""Language identification by compression: the language whose dictionary makes a text smallest.

For each language a raw-content Zstandard dictionary is put together from texts of that
language. A text, in lower case and with everything but letters turned into single blanks, is compressed as a
whole with each dictionary; the smallest result names the language. The score is a
softmax of the sizes, so narrow margins give low scores; below ``min_score`` the
answer is rejected (``accepted`` is false, the best guess stays in ``lang_pred``).

Defined cases: text that is null or holds no letter is ``und`` with score 0; so is every
text where no language could be learnt; equal sizes go to the first language by name;
repeated ids give a row each; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from textloom.llm.common import held_out, table

#: Texts of a language that its dictionary is taken from, at most, and the bytes of the dictionary.
MAX_FIT_DOCS, DICTIONARY_BYTES = 600, 256 << 10
#: Languages that may be learnt at most; more are refused.
MAX_LANGUAGES = 256
#: Zstandard level; bytes of difference in size that change the odds by a factor e, for texts of any length.
LEVEL, BYTES_PER_NAT = 5, 3.0

_ASCII = bytes(c | 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: By category: signs such as a half or a Roman numeral are none.
_LETTER = regex.compile(r"\p{L}")


def plain_letters(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_ASCII).split())


def learn(docs: DataFrame, max_docs: int = MAX_FIT_DOCS, size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """language -> dictionary, from at most max_docs texts a language (those with the smallest hash of their id) and size bytes.

    Each text gives a slice of its share of the dictionary, from a place in the whole text that the hash chooses; slices come in the order of
    the hashes, so neither long texts nor small ids count for more, and languages of two or three bytes a letter get as many texts as others.
    """
    may = docs.select("doc_id", "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).distinct()
    names = sorted(r["lang"] for r in may.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages")
    # ranked within a language; of each task only the first max_docs go on
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = may.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= max_docs)
    # languages times max_docs ids: a size bound that the number of documents cannot break
    ids = F.broadcast(chosen.select(F.col("doc_id").alias("__id"), F.col("lang").alias("__lang"), "__rank"))
    share = max(8, size // max_docs - 1)
    text = F.coalesce("text", F.lit(""))
    place = F.pmod(F.xxhash64(F.lit(1), F.col("doc_id")), F.greatest(F.length(text) - share + 1, F.lit(1))).cast("int")
    rows = docs.join(ids, (F.col("doc_id") == F.col("__id")) & (F.col("lang") == F.col("__lang"))).select("__lang", "__rank", F.substr(text, place + 1, F.lit(share)).alias("part"))
    # one slice for each id, whatever its number of rows
    found = rows.groupBy("__lang", "__rank").agg(F.min("part").alias("part")).toPandas().sort_values(["__lang", "__rank"])
    out = {}
    for n in names:
        # a set: copies of a text would only fill the dictionary
        texts = dict.fromkeys(plain_letters(t)[:share].decode("utf-8", "ignore").encode() for t in found[found["__lang"] == n]["part"])
        joined = b" ".join(t for t in texts if t)[:size]  # slices and the blanks between them fit, but for sizes of a few bytes a text
        if len(joined) >= 8:
            out[n] = joined
    return out


class Compressors:
    """One Zstandard compressor for each language, made once in a worker."""

    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.names = sorted(dictionaries)
        self.each = []
        for n in self.names:
            content = zstandard.ZstdCompressionDict(dictionaries[n], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            self.each.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=content, write_content_size=False, write_dict_id=False, write_checksum=False))

    def sizes(self, letters: bytes) -> np.ndarray:
        return np.array([len(c.compress(letters)) for c in self.each], float)

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.each or not _LETTER.search(text):
            return "und", 0.0
        sizes = self.sizes(plain_letters(text))
        best = int(sizes.argmin())
        odds = np.exp(-np.minimum((sizes - sizes[best]) / BYTES_PER_NAT, 50))
        return self.names[best], float(1 / odds.sum())


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", min_score: float = 0.6) -> DataFrame:
    """docs with lang_pred, score and accepted as last columns; no shuffle, whole texts."""
    new = ("lang_pred", "score", "accepted")
    names = [c for c in docs.columns if c not in new]
    schema = docs.select(*names).schema.add("lang_pred", T.StringType()).add("score", T.DoubleType()).add("accepted", T.BooleanType())

    def run(batches):
        tools = Compressors(dictionaries)
        for b in batches:
            found = [tools.predict(t.as_py()) for t in b.column(text)]
            pred, score = [f[0] for f in found], [f[1] for f in found]
            taken = [p != "und" and s >= min_score for p, s in found]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in names), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(taken, pa.bool_())], [*names, *new])

    return docs.select(*names).mapInArrow(run, schema)


def op7_language_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")

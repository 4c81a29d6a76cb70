"""Language identification by compression with per-language zstandard dictionaries.

Learning takes a bounded sample of the labelled rows: their whole texts are cut into pieces of PIECE characters, and per language
the SAMPLE pieces of lowest hash are the raw content of that language's dictionary. So a piece is as likely to come from the
end of a text as from its start. The number of dictionaries is the number of languages, so the broadcast doesn't grow with the rows.

Case, digits and ASCII punctuation are set aside on both sides. A longer dictionary compresses better whatever the language, so all
have the length of the shortest (of a bounded sample; a language of few labelled rows shortens the others to LEAST bytes at worst). A text is encoded block by block with every dictionary, each block alone, so the end of a long text counts
like its start. The smallest total names the language; ties go to the first language in order. The
score is the softmax of the negated sizes in units of a few per cent of the smallest, and a
prediction is rejected (a column; the language stays) when the runner-up is too close.

Null texts and texts without a letter are `und` with score 0. Nothing but the text is read to predict.
Without any labelled row every text is `und`. Rows are independent; repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventlens.llm.common import ship

#: Pieces per language and characters of each in a dictionary; bytes of a block; level; unit and margin of the score.
SAMPLE, PIECE, BLOCK, LEVEL = 120, 2000, 2048, 6
UNIT, MARGIN = 0.02, 0.02
UNKNOWN = "und"
#: Bytes that a dictionary may have even if another language has fewer; beyond that all are as long as the shortest.
LEAST = 32768
_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def dictionaries(df: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Raw-content dictionaries by language. The rank limit is applied before the shuffle, so a common language isn't gathered."""
    rows = df.where(learn & F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    pieces = F.posexplode(F.regexp_extract_all(text_col, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))).alias("at", "piece")
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("id"), pieces)
    rows = rows.select("lang", "piece", F.xxhash64("id", "at", "piece").alias("h"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "piece"))
    out: dict[str, list[str]] = {}
    for r in rows.withColumn("rank", rank).where(F.col("rank") <= SAMPLE).orderBy("lang", "rank").collect():
        out.setdefault(r.lang, []).append(r.piece)
    books = {lang: plain(" ".join(dict.fromkeys(pieces))) for lang, pieces in out.items()}
    most = max(LEAST, min(map(len, books.values()), default=0))
    return {lang: book[:most] for lang, book in books.items()}


def plain(text: str) -> bytes:
    """Lower case, runs of ASCII characters other than letters as one space."""
    return b" ".join(text.lower().encode().translate(_LETTERS).split())


def sizes(text: bytes, presses: list) -> list[int]:
    """The bytes that each dictionary needs for the whole text."""
    blocks = [text[at : at + BLOCK] for at in range(0, len(text), BLOCK)]
    return [sum(len(press(b)) for b in blocks) for press in presses]


def predict(df: DataFrame, books: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score and rejected of every whole text."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from math import exp

        langs = sorted(shared.value)
        presses = []
        for lang in langs:
            book = zstandard.ZstdCompressionDict(shared.value[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            book.precompute_compress(level=LEVEL)
            presses.append(zstandard.ZstdCompressor(dict_data=book, level=LEVEL, write_content_size=False, write_dict_id=False).compress)
        for batch in batches:
            out: list[tuple] = []
            for text in batch.column(1).to_pylist():
                if not langs or not text or not any(map(str.isalpha, text)):
                    out.append((UNKNOWN, 0.0, True))
                    continue
                size = sizes(plain(text), presses)
                best = min(size)
                unit = UNIT * best + 2
                weights = [exp((best - s) / unit) for s in size]
                at = size.index(best)
                rest = min((s for k, s in enumerate(size) if k != at), default=2 * best)
                out.append((langs[at], weights[at] / sum(weights), rest - best < MARGIN * best))
            cols = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.float64(), pa.bool_())))], [id_col, "lang_pred", "score", "rejected"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, rejected boolean")

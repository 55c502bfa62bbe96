"""Token counts: batches of about equal bytes go to the tokenizer inside Arrow functions; only lengths come back.

Texts longer than ``PIECE`` characters are cut at safe boundaries, so that no call holds a whole long text and the
sum over the parts is the count of the text. For the sentencepiece model a single space between two other
characters is such a boundary: white space is only ever the beginning of a piece, so no merge crosses it, and the
dummy space that the library puts before a text stands for the space that was cut. That the model has these
properties is tested before cutting; else texts stay whole. For tokenizers (.json) texts stay whole.

Defined cases: null and empty texts have no tokens; a null doc_id stays null; repeated rows each give a row; exactly ``limit`` tokens are
not over it; an empty table gives an empty result; extra columns are ignored. A long text without single inner spaces is one part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common as C

MODEL, LIMIT = "piece_bpe_32k.model", 4096
PIECE, BATCH_BYTES = 20_000, 1 << 20
SPACES = " ▁"


def parts(text: str, size: int = PIECE) -> list[str]:
    """``text`` cut at single inner spaces (which vanish) into parts of about ``size`` characters; longer where none is near."""
    out, at = [], 0
    while len(text) - at > size:
        cut = text.find(" ", at + size)
        while cut != -1 and (cut + 1 >= len(text) or text[cut - 1] in SPACES or text[cut + 1] in SPACES):
            cut = text.find(" ", cut + 1)
        if cut == -1:
            break
        out.append(text[at:cut])
        at = cut + 1
    out.append(text[at:])
    return out


def cuttable(model) -> bool:
    """Whether no piece has white space after another character, and a cut text gives the same tokens."""
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    inner = any("▁" in p.lstrip("▁") for p in pieces if not p.startswith("<"))
    probe = "a b\tcé \n d e"
    return not inner and model.encode("a b") == model.encode("a") + model.encode("b") and model.encode(probe + " x") == model.encode(probe) + model.encode("x")


_LOADED: dict[str, tuple[Callable[[list[str]], list[int]], bool]] = {}


def counter(path: str) -> tuple[Callable[[list[str]], list[int]], bool]:
    """A function from texts to token counts, and whether texts may be cut; loaded once per Python worker."""
    if path not in _LOADED:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _LOADED[path] = (lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]), cuttable(model)
        else:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            _LOADED[path] = (lambda texts: [len(x.ids) for x in tok.encode_batch(texts, add_special_tokens=False)]), False
    return _LOADED[path]


def count(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs``. ``path``: the tokenizer's file, on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, may_cut = counter(path)
        for b in batches:
            sizes, counts = [0] * len(b), [0] * len(b)
            waiting: list[str] = []
            owners: list[int] = []
            held = 0

            def flush():
                for k, n in zip(owners, lengths(waiting), strict=True):
                    counts[k] += n
                waiting.clear()
                owners.clear()

            for k, value in enumerate(b.column("text")):
                text = value.as_py() or ""
                sizes[k] = n = len(text.encode("utf-8", "surrogatepass"))
                cut = parts(text) if may_cut else [text]
                for part in cut:
                    waiting.append(part)
                    owners.append(k)
                    held += n if len(cut) == 1 else len(part.encode("utf-8", "surrogatepass"))
                    if held >= BATCH_BYTES:
                        flush()
                        held = 0
            flush()
            over = [n > limit for n in counts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array(over, pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count(C.table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))

"""Token counts of whole texts; huge ones are encoded in overlapping chunks.

Two chunks that overlap are spliced at a token that both encodings contain with the same place and id.  A sequence
of tokens is the encoding of its text exactly if each two neighbours encode to themselves; left of the shared token
all neighbours stand in the first chunk's encoding and right of it in the second's, so the spliced sequence is the
encoding of the whole.  Where an overlap shares no token, it is widened to twice its length; at the width of a
chunk both chunks become one.

Null texts count as empty and have no tokens.  Repeated rows get equal results; other columns are ignored.
"""
from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame

from .common import documents, map_arrow, text_of

#: Characters of a chunk and of the first overlap; tokens over which a text is too long for the model.
CHUNK, OVERLAP, LIMIT = 32_768, 64, 4096


@lru_cache(4)
def load(path: str):
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=path)


def _placed(model, text: str, start: int) -> list[tuple[int, int, int]]:
    """(begin, end, id) of the tokens, in bytes of the whole text."""
    return [(start + p.begin, start + p.end, p.id) for p in model.encode(text, return_type="proto").pieces]


def count_long(model, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of the text, from overlapping chunks of it."""
    end, begin, begin_byte = min(chunk, len(text)), 0, 0
    left = _placed(model, text[:end], 0)
    counted, anchor, at = 0, None, 0        # tokens of ``left`` before ``at`` are counted; ``anchor`` is the last of them
    while end < len(text):
        stop, width = min(len(text), end + chunk), overlap
        while True:
            start = max(begin, end - width)
            start_byte = begin_byte + len(text[begin:start].encode())
            right = _placed(model, text[start:stop], start_byte)
            places = {t: k for k, t in enumerate(right) if k and t[0] < t[1]}
            if start == begin:              # the overlap is the whole chunk: both are one now
                if anchor is not None and anchor not in places:
                    return len(model.encode(text))
                at, left = (places[anchor] + 1 if anchor else 0), right
                break
            shared = next((k for k in range(len(left) - 1, at - 1, -1) if left[k] in places), None)
            if shared is not None:
                counted, anchor = counted + shared + 1 - at, left[shared]
                at, left, begin, begin_byte = places[anchor] + 1, right, start, start_byte
                break
            width *= 2
        end = stop
    return counted + len(left) - at


def count_tokens(docs: DataFrame, path: str, text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP,
                 limit: int = LIMIT) -> DataFrame:
    """doc_id, bytes and tokens of every whole text, and whether the tokens exceed ``limit``."""
    def run(b):
        import pyarrow as pa
        model, texts = load(path), b.column("_text").to_pylist()
        short = [t for t in texts if len(t) <= chunk]
        counted = iter([len(x) for x in model.encode(short, num_threads=1)] if short else [])
        n = [next(counted) if len(t) <= chunk else count_long(model, t, chunk, overlap) for t in texts]
        return pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()),
             pa.array([x > limit for x in n])], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])
    df = docs.select("doc_id", text_of(docs, text).alias("_text"))
    return map_arrow(df, "_text", run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean", 1 << 20)


def vocabulary() -> str:
    import public_tokenizers
    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op7_token_counts(spark, folder):
    return count_tokens(documents(spark, folder), vocabulary())

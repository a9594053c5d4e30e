"""Token counts of a sentencepiece vocabulary by a whole-token shortcut."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from corpuslab.llm.common import batch, id_and_text, map_batches, tokenizer_path

MODEL = "piece_bpe_32k.model"
#: The sign for a space.
SPACE = "▁"
#: Counts that a Python worker remembers for pre-tokens outside the table, of up to so many characters each; it forgets all
#: when there are more.
REMEMBERED, LONGEST = 400_000, 48
LIMIT = 4096


class WholeTokens:
    """Counts the tokens of a text as the library does, one pre-token at a time.

    What is proved from the vocabulary when this is made, before any text is seen:

    * no piece has ``SPACE`` after another character, so no merge joins a pre-token to the one before it;
    * the line feed is in no piece but its byte, so it is always one token and parts what stands around it;
    * the normaliser changes nothing but spaces (it is held against a text that would show it);
    * which pieces, encoded alone, give one token: these are the table of whole tokens.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces):
            raise ValueError("a piece spans pre-tokens")
        probe = "ﬁ é　 A  b "
        if sp.decode(sp.encode(probe)) != probe or sp.encode("a") != sp.encode(SPACE + "a")[-1:]:
            raise ValueError("the normaliser rewrites texts")
        self.gap = len(sp.encode("\n")) - 1  # tokens that the library puts before a line feed
        alone = self.merge(pieces)
        self.whole = {p: 1 for p, n in zip(pieces, alone, strict=True) if n == 1}
        self.known = dict(self.whole)

    def merge(self, parts: list[str]) -> list[int]:
        """Numbers of tokens of pre-tokens, by merging. A line feed before each keeps the library from adding a space."""
        return [len(x) - 1 - self.gap for x in self.sp.encode(["\n" + p for p in parts], num_threads=1)]

    #: A run of spaces and what follows it; a line feed is left out and counted apart.
    PARTS = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+")

    def count(self, texts: list[str]) -> list[int]:
        known = self.known
        if len(known) > REMEMBERED:
            known = self.known = dict(self.whole)
        split = [self.PARTS.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        rest = list({p for parts in split for p in parts if p not in known})
        known.update(zip(rest, self.merge(rest), strict=True))
        out = [sum(map(known.__getitem__, parts)) + t.count("\n") for parts, t in zip(split, texts, strict=True)]
        for p in rest:
            if len(p) > LONGEST:
                del known[p]
        return out


@lru_cache(1)
def _counter(path: str) -> WholeTokens:
    return WholeTokens(path)


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, folder: str | None = None) -> DataFrame:
    """One row for each row of ``df``: doc_id, n_bytes, n_tokens, over_limit.

    Counts are those of the library without begin, end or added tokens; special strings in a text are ordinary text,
    as is the library's default. A null or empty text has no token. Ids may be null or repeat, and each row counts; an empty
    table gives no rows; texts may be of any length; columns other than id and text (``n_tokens``, say) are left out. There
    is no shuffle; each task holds one batch of texts and a memory of counts that is bounded in entries and in bytes.
    """

    def make():
        counter = _counter(tokenizer_path(MODEL, folder))

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = b.column("text").to_pylist()
            n: list[int] = []
            for i in range(0, len(texts), 256):
                n += counter.count(texts[i : i + 256])
            return batch(doc_id=(b.column("doc_id"), None), n_bytes=([len(t.encode()) for t in texts], pa.int64()), n_tokens=(n, pa.int64()), over_limit=([x > limit for x in n], pa.bool_()))

        return run

    rows = id_and_text(df, id_col, text_col)
    return map_batches(rows, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean", make)

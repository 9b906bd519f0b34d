"""Token counts with a whole-token shortcut.

From the vocabulary alone it is proven which strings encode as one token: a piece that the merge
engine, given that piece, answers with its own id. A text is cut into pre-tokens at places no
merge can cross (see `pieces`); those in the proven table count one each without any merging, and
only the rest is merged.
"""

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayloom.llm.pieces import NORMAL, PieceModel, chunks, forget, piece_model, remember


def whole_tokens(model: PieceModel) -> list[str]:
    """The pieces that encode alone as one token, proven by encoding each of them."""
    pieces = [(i, p) for i, (p, kind) in enumerate(zip(model.pieces, model.kinds, strict=True)) if kind == NORMAL]
    coded = model.merger.encode([p for _, p in pieces], num_threads=1)
    return [p for (i, p), ids in zip(pieces, coded, strict=True) if ids == [i]]


class TokenCounter:
    """Tokens of pre-tokens: whole tokens are known from the start, others are merged as they come up."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.whole = dict.fromkeys(whole_tokens(model), 1)
        self.known = dict(self.whole)

    def _merge(self, segments: list[str]) -> list[int]:
        return [len(ids) for ids in self.model.merger.encode(segments, num_threads=1)]

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each whole text, without begin and end."""
        counts = []
        for cut in chunks(texts):
            segments = [self.model.segments(t) for t in cut]
            remember(self.known, segments, self._merge)
            counts += [sum(map(self.known.__getitem__, s)) for s in segments]
            forget(self.known, self.whole)
        return counts


@lru_cache(maxsize=4)
def token_counter(path: str) -> TokenCounter:
    return TokenCounter(piece_model(path))


def count_tokens(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every text, in one pass without a shuffle.

    NULL counts as empty and has 0 tokens. Strings that look like special tokens are ordinary
    text, as in the library. Other columns are ignored, whatever their names.
    """

    def run(batches):
        counter = token_counter(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = counter.count(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=[id, "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(F.col(id).alias(id), F.col(text).alias("__text"))
    return rows.mapInArrow(run, f"`{id}` {docs.schema[id].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean")

"""Exact token counts at every prefix.

Two levels of prefix table. A text is cut where no vocabulary piece can reach across: before a run of
spaces, and around line feeds, which only byte fallback encodes. Merges never cross such a cut, so the
count of a prefix that ends at a cut is the sum of the segments before it: cumulated sums hold it for
every segment. Within a segment, a dynamic program over its prefixes gives the count of every shorter
one: the last token of a prefix is the one vocabulary piece that ends there and forms a valid pair with
the last token of what is left. Distinct segments are encoded once; their counts are kept under
64-bit hashes.

Null text is empty text and has no tokens. Repeated rows are counted each. Texts of any length are cut
into segments. An empty table gives an empty result. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from evalweave.llm.common import blocks, tune, utf8
from evalweave.llm.words import Known, U, span_hashes

LIMIT = 4096
#: The counts of so many distinct segments are kept; then the store starts anew.
STORE = 1_000_000
_SPACE, _LF = 0x20, 0x0A


class PrefixTokens:
    """Counts for one sentencepiece model with identity normalisation, a dummy prefix and byte fallback."""

    def __init__(self, model: str):
        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.known = Known(STORE)
        self.pairs: dict[tuple[str, str], bool] = {}
        pieces = {self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size()) if not (self.sp.is_control(i) or self.sp.is_byte(i) or self.sp.is_unknown(i))}
        self.pieces, self.longest = pieces, max(map(len, pieces))
        # What the cuts rest on: no piece has a space mark after another character, or a line feed.
        inner = any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)
        if inner or self.sp.encode("\n ﬁ ", out_type=str)[-2:] != ["ﬁ", "▁"]:
            raise ValueError("this model merges across spaces or normalises texts")

    def _encode(self, segments: list[bytes]) -> list[int]:
        # After a line feed a segment stands as it is inside a text; the mark and the line feed are two tokens.
        out = self.sp.encode(["\n" + s.decode("utf-8", "replace") for s in segments], num_threads=1)
        return [len(x) - 2 for x in out]

    def table(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of many texts: byte at which each segment starts, tokens of each, first segment of each text."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
        begin = np.zeros(n + 1, bool)
        begin[off] = True
        space, feed = data == _SPACE, data == _LF
        # A space starts a segment unless a space or a literal mark (E2 96 81) stands before it.
        mark = np.zeros(n, bool)
        mark[2:] = (data[2:] == 0x81) & (data[1:-1] == 0x96) & (data[:-2] == 0xE2)
        begin[1:n] |= space[1:] & ~space[:-1] & ~mark[:-1]
        begin[:n] |= feed
        begin[1:n] |= feed[:-1]
        starts = np.flatnonzero(begin[:n])
        ends = np.append(starts[1:], n)
        first = np.searchsorted(starts, off)
        leads = np.zeros(len(starts), bool)
        leads[first[:-1][np.diff(off) > 0]] = True  # the dummy prefix goes before a text's first segment
        keys = span_hashes(data, starts, ends) ^ np.where(leads, U(0x5851F42D4C957F2D), U(0))
        distinct, example, place = np.unique(keys, return_index=True, return_inverse=True)
        raw = data.tobytes()

        def encode(new: np.ndarray) -> list[int]:
            at = example[new]
            return self._encode([(b" " if lead else b"") + raw[a:b] for a, b, lead in zip(starts[at].tolist(), ends[at].tolist(), leads[at].tolist(), strict=True)])

        return starts, self.known.look_up(distinct, encode)[place], first

    def _pair(self, a: str, b: str) -> bool:
        if (a, b) not in self.pairs:
            if len(self.pairs) > STORE:
                self.pairs.clear()
            self.pairs[a, b] = self.sp.encode("\n" + (a + b).replace("▁", " "), out_type=str)[2:] == [a, b]
        return self.pairs[a, b]

    def prefixes(self, segment: str) -> list[int]:
        """Tokens of each prefix of a segment (0 to all characters), spaces standing for themselves."""
        s = segment.replace(" ", "▁")
        count, last = [0], [""]
        for i in range(1, len(s) + 1):
            for j in range(max(0, i - self.longest), i):
                t = s[j:i]
                if t in self.pieces and (not j or last[j] is None or self._pair(last[j], t)):
                    count.append(count[j] + 1)
                    last.append(t)
                    break
            else:  # a character without a piece of its own: its bytes
                count.append(count[i - 1] + len(s[i - 1].encode()))
                last.append(None)
        return count

    def fit(self, text: str, budget: int) -> int:
        """Characters of the longest prefix of at most so many tokens, from the tables alone."""
        raw = text.encode()
        starts, counts, _ = self.table(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        return self._fit(raw, starts, counts, budget)

    def _fit(self, raw: bytes, starts: np.ndarray, counts: np.ndarray, budget: int) -> int:
        before = np.cumsum(counts) - counts
        if not len(counts) or before[-1] + counts[-1] <= budget:
            return len(raw.decode("utf-8", "replace"))
        k = int(np.searchsorted(before, budget, "left")) - 1  # the last segment with some budget left
        if k < 0:
            return 0
        end = starts[k + 1] if k + 1 < len(starts) else len(raw)
        segment = (b" " if k == 0 else b"") + raw[starts[k] : end]
        within = self.prefixes(segment.decode("utf-8", "replace"))
        most = max(i for i, c in enumerate(within) if before[k] + c <= budget)
        return len(raw[: starts[k]].decode("utf-8", "replace")) + max(0, most - (k == 0))


@lru_cache(maxsize=2)
def tables(model: str) -> PrefixTokens:
    return PrefixTokens(model)


def count_tokens(docs: DataFrame, spark: SparkSession, model: str, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_tokens, over_limit, and fit_chars: characters that fit into the limit."""
    tune(spark)
    fields = pa.schema([("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()), ("fit_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tables(model)
        for batch in batches:
            data, off = utf8(batch.column(1))
            total, fits = np.zeros(len(off) - 1, np.int64), np.zeros(len(off) - 1, np.int64)
            for a, b in blocks(off):
                part, at = data[off[a] : off[b]], off[a : b + 1] - off[a]
                starts, counts, first = own.table(part, at)
                upto = np.concatenate([[0], np.cumsum(counts)])
                total[a:b] = upto[first[1:]] - upto[first[:-1]]
                chars = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
                fits[a:b] = chars[at[1:]] - chars[at[:-1]]
                for i in np.flatnonzero(total[a:b] > limit):
                    s = slice(first[i], first[i + 1])
                    fits[a + i] = own._fit(part[at[i] : at[i + 1]].tobytes(), starts[s] - at[i], counts[s], limit)
            columns = [pa.array(np.diff(off)), pa.array(total), pa.array(total > limit), pa.array(fits)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[key, *fields.names])

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long"
    return docs.select(key, text).mapInArrow(run, schema)

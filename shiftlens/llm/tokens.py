"""Token counts by heap-and-linked-list byte-pair merging.

A text becomes symbols in a doubly linked list; a heap holds the adjacent pairs whose
joining is a piece, and the best-ranked, then leftmost, pair is merged until none is
left. The count is the initial symbols less the merges; a symbol outside the
vocabulary counts as its UTF-8 bytes (byte fallback). No identifiers are made.

No merge crosses a place where no piece has the two characters side by side, such as
the start of a word (taken from the vocabulary on loading), so a text's count is the
sum over its segments. Counts of short segments are remembered in a table of bounded
size.

Rows are independent: no shuffle, one pass. Defined results: null and empty texts have
0 bytes and tokens; repeated rows repeat; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
#: So many remembered segments a worker, each of so many characters at most.
REMEMBER, WORD_CHARS = 500_000, 32
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class Known(dict):
    """Counts by string, computed on first use; emptied when full."""

    def __init__(self, count):
        super().__init__()
        self.count = count

    def __missing__(self, s: str) -> int:
        n = self.count(s)
        if len(s) <= WORD_CHARS:
            if len(self) >= REMEMBER:
                self.clear()
            self[s] = n
        return n


class Merger:
    """Counts the tokens that a SentencePiece BPE model gives. Inside, a space stands for the word mark."""

    def __init__(self, model_file: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(SentencePieceProcessor(model_file=model_file).serialized_model_proto())
        norm, train = model.normalizer_spec, model.trainer_spec
        plain = not norm.precompiled_charsmap and not norm.remove_extra_whitespaces and norm.escape_whitespaces
        kinds = {p.type for p in model.pieces}
        if train.model_type != 2 or not train.byte_fallback or not plain or kinds - {1, 2, 3, 6}:
            raise ValueError(f"{model_file}: only BPE with byte fallback, identity normalisation and no user-defined or unused pieces")
        self.prefix = " " if norm.add_dummy_prefix else ""
        pieces = {p.piece.replace(MARK, " "): p.score for p in model.pieces if p.type == 1}
        order = {score: k for k, score in enumerate(sorted(set(pieces.values()), reverse=True))}
        self.rank = {piece: order[score] for piece, score in pieces.items()}
        self.chars = {p for p in pieces if len(p) == 1}
        self.words = self.segments(pieces)
        self.known = Known(self.merge)

    @staticmethod
    def segments(pieces) -> re.Pattern:
        """Cuts a text where no merge can cross: where no piece has the two characters side by side.

        Those places are the starts of words, line ends, and the end of a run of word
        characters; a run ending in one that some piece continues isn't cut there.
        """
        adjacent = {pair for p in pieces for pair in zip(p, p[1:], strict=False)}
        if any(b == " " != a for a, b in adjacent):
            return re.compile(r".+", re.S)
        glue = "".join(sorted({a for a, b in adjacent if b != " " and re.match(r"\w\W", a + b)}))
        line = "" if any("\n" in pair for pair in adjacent) else r"\n"
        rest = f"(?:(?<=[{re.escape(glue)}])[^ {line}]+)?" if glue else ""
        word = rf"[^\w {line}]*\w+{rest}|[^\w {line}]+"
        return re.compile(rf" *(?:{word})| +" + (r"|\n+" if line else ""))

    def merge(self, text: str) -> int:
        get, n = self.rank.get, len(text)
        sym = list(text)
        best = [get(text[i : i + 2]) for i in range(n - 1)]  # rank of the pair that begins at i
        heap = [r * n + i for i, r in enumerate(best) if r is not None]
        best.append(None)
        merges = 0
        if heap:
            heapq.heapify(heap)
            pop, push = heapq.heappop, heapq.heappush
            prev, nxt = list(range(-1, n - 1)), list(range(1, n + 1))
            while heap:
                r, a = divmod(pop(heap), n)
                if best[a] != r:
                    continue  # one of the two has been merged meanwhile
                b = nxt[a]
                s = sym[a] = sym[a] + sym[b]
                sym[b], best[b] = "", None
                merges += 1
                c = nxt[a] = nxt[b]
                r = None
                if c < n:
                    prev[c] = a
                    r = get(s + sym[c])
                    if r is not None:
                        push(heap, r * n + a)
                best[a] = r
                p = prev[a]
                if p >= 0:
                    r = best[p] = get(sym[p] + s)
                    if r is not None:
                        push(heap, r * n + p)
        if self.chars.issuperset(text):
            return n - merges
        return n - merges + sum(len(s.encode("utf-8", "surrogatepass")) - 1 for s in sym if s and s not in self.rank)

    def count(self, text: str) -> int:
        if not text:
            return 0
        return sum(map(self.known.__getitem__, self.words.findall(self.prefix + text.replace(MARK, " "))))


@functools.lru_cache(maxsize=2)
def merger(model_file: str) -> Merger:
    """One a worker and model."""
    return Merger(model_file)


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit, a row per document.

    ``model_file`` is a SentencePiece BPE model at a path that every worker has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = merger(model_file).count
        for batch in batches:
            n_bytes, n_tokens = [], []
            for cell in batch.column(1):
                text = cell.as_py() or ""
                n_bytes.append(len(text.encode()))
                n_tokens.append(count(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(run, SCHEMA)

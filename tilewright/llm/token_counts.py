"""Token counts under a unigram vocabulary, by dynamic programming over a trie of pre-tokens.

The best segmentation of a prefix depends on the prefix alone, so distinct pre-tokens are put into one trie and the
forward score (best log probability and its number of tokens) is computed once for each node, that is once for each
shared prefix. A pre-token's count is read at its terminal node.

Scores come from a public vocabulary: pieces in their order, with the Zipf log probability ``-ln(rank + 2.7)`` (nothing
is trained). Pre-tokens are the white-space separated words of a text with the word mark before each. A character that
no piece covers counts as its UTF-8 bytes. Equal scores: fewer tokens win.

Defined cases: null or empty text has 0 tokens; a word of any length is one path of the trie; repeated rows give
repeated results; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.common import arrow_map, pieces, table

MARK = "▁"
ZIPF_SHIFT = 2.7
#: Log probability of each byte of an uncovered character; below any piece's.
BYTE_SCORE = -20.0
#: Trie nodes that a task holds before it starts a new trie.
MOST_NODES = 1_000_000


def zipf_scores(pieces_in_order: list[str]) -> dict[str, float]:
    norm = math.log(sum(1 / (r + ZIPF_SHIFT) for r in range(len(pieces_in_order))) or 1)
    out: dict[str, float] = {}
    for r, p in enumerate(pieces_in_order):
        out.setdefault(p, -math.log(r + ZIPF_SHIFT) - norm)
    return out


def sentencepiece_pieces(model_file: str) -> list[str]:
    """The ordinary pieces of a model in id order: no control, unknown or byte pieces."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]


class Trie:
    """Pre-tokens of a task; ``count(word)`` adds what is missing and returns the terminal count."""

    def __init__(self, scores: dict[str, float]):
        self.scores, self.longest = scores, max(map(len, scores), default=1)
        self.clear()

    def clear(self) -> None:
        self.next: dict[tuple[int, str], int] = {}
        self.score, self.tokens = [0.0], [0]
        self.terminal: dict[str, int] = {}

    def count(self, word: str) -> int:
        found = self.terminal.get(word)
        return self.insert(word) if found is None else found

    def insert(self, word: str) -> int:
        if len(self.score) > MOST_NODES:
            self.clear()
        node, path, nxt, score, tokens, scores = 0, [0], self.next, self.score, self.tokens, self.scores
        for end, ch in enumerate(word, 1):
            child = nxt.get((node, ch))
            if child is None:
                size = len(ch.encode("utf-8", "replace"))
                best, n = score[node] + size * BYTE_SCORE, tokens[node] + size
                for begin in range(max(0, end - self.longest), end):
                    s = scores.get(word[begin:end])
                    if s is not None:
                        at = path[begin]
                        s += score[at]
                        if s > best or s == best and tokens[at] + 1 < n:
                            best, n = s, tokens[at] + 1
                child = nxt[node, ch] = len(score)
                score.append(best)
                tokens.append(n)
            node = child
            path.append(node)
        self.terminal[word] = tokens[node]
        return tokens[node]


def count_tokens(docs: DataFrame, vocabulary: list[str], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_pretokens, n_tokens. Narrow: no shuffle, no state beyond a task's trie of bounded size."""
    scores = zipf_scores(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(scores)
        for b in pieces(batches):
            words = [(t or "").split() for t in b.column(1).to_pylist()]
            counts = {w: trie.count(MARK + w) for w in set().union(*words)}
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(w) for w in words], pa.int64()), pa.array([sum(map(counts.__getitem__, w)) for w in words], pa.int64())], names=["doc_id", "n_pretokens", "n_tokens"])

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, n_pretokens long, n_tokens long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), sentencepiece_pieces(public_tokenizers.path("piece_bpe_32k.model")))

"""Token counts by a unigram vocabulary: Viterbi over Aho-Corasick matches, counts only."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import batch_of

SPACE = "▁"

# What an unknown character costs beyond the least score, fixed by the tokenizers library.
UNKNOWN_PENALTY = 10.0

# Words held by one Python worker; beyond that it starts anew.
CACHED_WORDS = 500_000


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a SentencePiece file, by id."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter(dict):
    """Pieces and score of the best segmentation of a word, found once per word.

    A word starts with the sign for a space and holds no other, and pieces hold that
    sign in front only where it matters: words are segmented one by one.
    """

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        super().__init__()
        self.machine = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.machine.add_word(piece, (len(piece), score))
        self.machine.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        names = {piece for piece, _ in pieces}
        self.bytes = all(f"<0x{b:02X}>" in names for b in range(256))

    def __missing__(self, word: str) -> tuple[int, float]:
        found = self.segment(word)
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = found
        return found

    def segment(self, word: str) -> tuple[int, float]:
        """Piece count and score of the best path, without the path.

        Of equal scores at one end the piece that starts first wins, as the library
        visits starts from left to right and replaces a path by a better one only. The
        automaton gives the pieces that end at a place longest first, in that order. A
        character that is no piece itself is unknown: it counts as its bytes, or, in a
        vocabulary without bytes, as one together with the unknown ones next to it.
        """
        n = len(word)
        best = [0.0] + [None] * n
        count = [0] * (n + 1)
        lost = [False] * (n + 1)  # the path ends with an unknown character
        ends: list[list] = [[] for _ in range(n + 1)]
        for last, (length, score) in self.machine.iter(word):
            ends[last + 1].append((length, score))
        for end in range(1, n + 1):
            top, single = None, False
            for length, score in ends[end]:
                single = single or length == 1
                total = best[end - length] + score
                if top is None or total > top:
                    top, count[end], lost[end] = total, count[end - length] + 1, False
            if not single:
                total = best[end - 1] + self.unknown
                if top is None or total > top:
                    top = total
                    if self.bytes:
                        count[end] = count[end - 1] + len(word[end - 1].encode("utf-8", "replace"))
                    else:
                        count[end] = count[end - 1] + (not lost[end - 1])
                    lost[end] = True
            best[end] = top
        return count[n], best[n]

    def text(self, text: str | None) -> tuple[int, float]:
        """Pieces and score of a whole text; null and empty have none."""
        if not text:
            return 0, 0.0
        marked = text.replace(" ", SPACE)
        words = (marked[1:] if marked[0] == SPACE else marked).split(SPACE)
        pieces, score = 0, 0.0
        for n, s in map(self.__getitem__, [SPACE + w for w in words]):
            pieces += n
            score += s
        return pieces, score


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One per Python worker, so that its words outlive a task."""
    return Counter(vocabulary(path))


def token_counts(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, n_tokens, score`` for every row: the tokens of the whole text under the
    unigram vocabulary in ``model`` and the summed scores of its pieces.

    Spaces become the sign that starts a word, and one is put in front. Null and empty
    texts have no tokens; repeated rows and null ids are answered one by one.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("score", pa.float64())])

    def run(batches):
        count = counter(model).text
        for batch in batches:
            found = [count(t) for t in batch.column(1).to_pylist()]
            yield batch_of(schema, {"doc_id": batch.column(0), "n_tokens": [n for n, _ in found],
                                    "score": [s for _, s in found]})

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, score double")

"""Token counts under a unigram vocabulary, by a Viterbi pass that keeps counts only.

An Aho-Corasick automaton enumerates the vocabulary matches of a word by their ends; for each end the dynamic program
keeps the best score and the number of pieces on the best path, in a ring as long as the longest piece, so memory
doesn't grow with the word. Ties follow the tokenizer: of equal scores the path whose last piece starts earliest (the
longest piece) stands, and a character that no piece of its own covers may be one unknown piece, whose score is the
least of the vocabulary less UNK_PENALTY. Runs of unknown pieces count as one (fuse_unk).

The tokenizer meant: tokenizers' Unigram model over the pieces and scores of a sentencepiece model file, after
splitting at white space and putting the meta space before each word. Words are independent, so counts of recent words
are remembered in a table of bounded size. A null text has no tokens.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from .common import map_texts

META = "▁"
UNK_PENALTY = 10.0
MEMO_CHARS, MEMO_SIZE = 32, 300_000
#: Fixed value: the characters with Unicode's White_Space property.
SPACE = "\t-\r \x85\xa0  -     　"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_vocabulary(path: str) -> tuple[list[tuple[str, float]], int]:
    """((piece, score) by id, id of the unknown piece) of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())], model.unk_id()


class Counter:
    """Counts the pieces of words; the state for a word is a ring of (score, pieces, unknown before) entries."""

    _loaded: dict[str, Counter] = {}

    def __init__(self, vocabulary: list[tuple[str, float]], unk_id: int):
        import ahocorasick

        self.unk_score = min(s for _, s in vocabulary) - UNK_PENALTY
        self.automaton = ahocorasick.Automaton()
        for i, (piece, score) in enumerate(vocabulary):
            if piece:
                self.automaton.add_word(piece, (len(piece), score, i == unk_id))
        self.automaton.make_automaton()
        self.ring = max(len(p) for p, _ in vocabulary) + 1
        self.memo: dict[str, int] = {}
        self.older: dict[str, int] = {}  # the memo before; frequent words come back from it
        self.words = re.compile(f"[^{SPACE}]+").findall

    @classmethod
    def of(cls, path: str) -> Counter:
        if path not in cls._loaded:
            cls._loaded[path] = cls(*load_vocabulary(path))
        return cls._loaded[path]

    def count_word(self, word: str) -> int:
        """Pieces of one pre-token, the meta space included in word."""
        size, ring = len(word), self.ring
        score, pieces, unk = [0.0] * ring, [0] * ring, [False] * ring
        matches = self.automaton.iter(word)
        end, found = next(matches, (size, None))
        end += 1
        for at in range(1, size + 1):
            best, came, n, was_unk, single = None, 0, 0, False, False
            while end == at and found is not None:
                length, own, is_unk = found
                j = (at - length) % ring
                value = own + score[j]
                if length == 1:
                    single = True
                if best is None or value > best or (value == best and length > came):
                    best, came, n, was_unk = value, length, pieces[j] + (not (is_unk and unk[j])), is_unk
                end, found = next(matches, (size, None))
                end += 1
            if not single:
                j = (at - 1) % ring
                value = self.unk_score + score[j]
                if best is None or value > best:
                    best, n, was_unk = value, pieces[j] + (not unk[j]), True
            j = at % ring
            score[j], pieces[j], unk[j] = best, n, was_unk
        return pieces[size % ring]

    def count(self, text: str) -> int:
        total, memo = 0, self.memo
        for word in self.words(text):
            got = memo.get(word)
            if got is None:
                got = self.older.get(word)
                if got is None:
                    got = self.count_word(META + word)
                if len(word) <= MEMO_CHARS:
                    if len(memo) >= MEMO_SIZE:
                        self.older, self.memo = memo, {}
                        memo = self.memo
                    memo[word] = got
            total += got
        return total


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens of every document."""
    path = path or default_path()

    def row(text: str | None) -> tuple[int, int]:
        counter = Counter.of(path)
        return len(counter.words(text or "")), counter.count(text or "")

    return map_texts(docs, "text", row, ["doc_id"], "n_words long, n_tokens long")

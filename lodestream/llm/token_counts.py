"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

A pre-token is a run of characters between spaces, with the mark of a word start.
Its token count is that of its most probable segmentation into vocabulary pieces.
The distinct pre-tokens of a batch are sorted, which walks their trie depth
first: the forward scores of a prefix are computed once and shared by all
pre-tokens below it. Counts at terminal nodes are remembered and looked up for
each occurrence.

Piece log-probabilities follow Zipf's law over the public vocabulary's own order
(the file has no unigram probabilities). A character that no piece covers costs
one byte token for each of its UTF-8 bytes. A null or empty text has no tokens.
Texts of any length are read whole. Of segmentations as probable, the one whose
last piece is longest counts. Repeated rows are repeated results; an empty table
gives an empty one; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame

from lodestream.llm.common import id_and_text, slices
from lodestream.llm.tokens import public_path

MARK = "▁"
#: Log-probability of a byte token, below that of any piece.
BYTE_SCORE = -25.0
#: Pre-tokens that a task remembers, and their letters.
_KEPT, _KEPT_LETTERS = 400_000, 64


def piece_scores(path: str) -> dict[str, float]:
    """log(1 / ((rank + 3) * H)) for the pieces of a SentencePiece file, in its order; control and byte pieces have none."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(k) for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))]
    total = log(sum(1 / (k + 3) for k in range(len(pieces))))
    return {p: -log(k + 3) - total for k, p in enumerate(pieces)}


class TrieCounter:
    """Forward scores along a trie of pre-tokens."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.known: dict[str, int] = {}

    def learn(self, words: set[str]) -> None:
        """Adds the token counts of ``words``, sharing the work of common prefixes."""
        get, longest, known = self.scores.get, self.longest, self.known
        best, count, before = [0.0], [0], ""
        for word in sorted(words):
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del best[shared + 1 :], count[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                char = len(word[end - 1].encode())
                top, tokens = best[end - 1] + char * BYTE_SCORE, count[end - 1] + char
                for start in range(max(0, end - longest), end):
                    score = get(word[start:end])
                    if score is not None and best[start] + score > top:
                        top, tokens = best[start] + score, count[start] + 1
                best.append(top)
                count.append(tokens)
            known[word] = count[len(word)]
            before = word

    def forget(self, words: set[str]) -> None:
        """Drops words too long to keep; so the cache is bounded in bytes too."""
        for word in words:
            if len(word) > _KEPT_LETTERS:
                del self.known[word]


def token_counts(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pretokens, n_tokens. One pass over the texts, no shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TrieCounter(piece_scores(public_path(vocabulary)))
        for batch in slices(batches):
            texts = batch["text"].to_pylist()
            n_words, n_tokens = [], []
            for k in range(0, len(texts), 500):
                split = [[MARK + x for x in t.split(" ") if x] for t in texts[k : k + 500]]
                new = {x for words in split for x in words} - counter.known.keys()
                if len(counter.known) + len(new) > _KEPT:
                    new = {x for words in split for x in words}
                    counter.known = {}
                counter.learn(new)
                get = counter.known.__getitem__
                n_words += map(len, split)
                n_tokens += [sum(map(get, words)) for words in split]
                counter.forget(new)
            yield pa.record_batch({"doc_id": batch["doc_id"], "n_pretokens": pa.array(n_words, pa.int64()), "n_tokens": pa.array(n_tokens, pa.int64())})

    return id_and_text(docs, id_col, text_col).mapInArrow(work, "doc_id long, n_pretokens long, n_tokens long")

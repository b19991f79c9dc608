"""Token counts by the whole-token shortcut.

Offline, every vocabulary string that ends a word is encoded alone; the strings that come back
as exactly one token are proven whole tokens. A pre-token in that set counts 1 without any
merge; only the others are merged (and remembered, in a bounded memo). That holds for texts of
any script: where the pre-tokens of a text are not certain, the library's normaliser and
pre-tokenizer split it, and its pieces are looked up in the same set.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from voxloom.llm import wordbpe
from voxloom.llm.base import map_rows, table, texts

LIMIT = 2048
#: Characters up to which a run between spaces is remembered.
CHUNK = 64


def prove_whole(path: str) -> frozenset[str]:
    """Word-end strings of the vocabulary that encode alone as that one token. Bounded by the
    vocabulary's size."""
    bpe, letters = wordbpe.WordBpe(path), wordbpe.byte_letters()
    strings, ids = [], []
    for token, i in bpe.lib.get_vocab(with_added_tokens=False).items():
        if token.endswith("</w>"):
            try:
                strings.append(bytes(letters[c] for c in token[:-4]).decode())
            except (KeyError, UnicodeDecodeError):
                continue
            ids.append(i)
    found = bpe.lib.encode_batch(strings, add_special_tokens=False)
    return frozenset(s for s, i, e in zip(strings, ids, found, strict=True) if e.ids == [i] and _one_piece(bpe, s))


def _one_piece(bpe: wordbpe.WordBpe, s: str) -> bool:
    found = wordbpe.pieces(s)
    return found == [s] if found is not None else bpe.split(s) == [bpe.stand_ins(s)]


class Counter:
    """Tokens of a text: 1 for each proven whole pre-token and each special string, merges for the rest."""

    def __init__(self, path: str, whole: frozenset[str]):
        self.bpe, self.whole = wordbpe.load(path), whole
        in_letters = frozenset(map(self.bpe.stand_ins, whole))
        self.pieces = wordbpe.Memo(lambda p: 1 if p in whole else len(self.bpe.piece_ids(p)))
        # the same for pieces in byte stand-ins, as the library splits
        self.letters = wordbpe.Memo(lambda p: 1 if p in in_letters else len(self.bpe.model.tokenize(p)), wordbpe.MEMO // 4)
        self.chunks = wordbpe.Memo(self.chunk, wordbpe.MEMO // 4)

    def count(self, text: str) -> int:
        found = wordbpe.pieces(text)
        if found is not None:
            return sum(map(self.pieces.__getitem__, found))
        between = wordbpe.parts(text)
        # neither normal forms nor pre-tokens reach across a space
        return len(between) - 1 + sum(self.chunks[c] if len(c) <= CHUNK else self.chunk(c) for part in between for c in part.split(" "))

    def chunk(self, text: str) -> int:
        """Tokens of a text without special strings."""
        found = wordbpe.pieces(text)
        return sum(map(self.pieces.__getitem__, found)) if found is not None else sum(map(self.letters.__getitem__, self.bpe.split(text)))


def token_counts(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """Tokens of every document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Narrow: one pass over the scan, no shuffle. Null and empty texts have 0 bytes and 0 tokens;
    a null id stays null; repeated rows give repeated results; an empty table gives no rows; other
    columns are ignored. A special string inside a text counts 1; what stands between is split by
    itself.
    """
    whole = df.sparkSession.sparkContext.broadcast(prove_whole(tokenizer_path))

    def rows(feed: Iterator[tuple]) -> Iterator[tuple]:
        counter = Counter(tokenizer_path, whole.value)
        for doc_id, text in feed:
            text = text or ""
            n = counter.count(text)
            yield doc_id, len(text.encode()), n, n > limit

    return map_rows(texts(df, id_col, text_col), rows, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", keep="wordbpe")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))

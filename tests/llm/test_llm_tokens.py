import random

import sentencepiece
from awkward import documents, none

from tallyloom.llm import tokens
from tallyloom.llm.tokens import Encoder, model_path, token_counts

PARTS = ["a", "b ", "  ", "▁", "\n", "é", "<s>", "</s>", " ", "１", "the ", "\t", "x" * 30, "日本"]


def plain():
    return sentencepiece.SentencePieceProcessor(model_file=model_path())


def test_any_text_counts_as_the_library_counts(monkeypatch):
    monkeypatch.setattr(tokens, "PIECE_BYTES", 50)
    encoder, library, dice = Encoder(), plain(), random.Random(3)
    texts = ["".join(dice.choice(PARTS) for _ in range(dice.randint(0, 200))) for _ in range(400)]
    texts += ["", " ", "  ", "▁", "a ", " a", "a" * 500]
    assert encoder.counts(texts) == [len(ids) for ids in library.encode(texts)]


def test_awkward_rows(spark):
    docs = documents(spark)
    library = plain()
    wanted = sorted(
        (r.doc_id or -1, len((r.text or "").encode()), len(library.encode(r.text or "")), len(library.encode(r.text or "")) > 4096)
        for r in docs.collect()
    )
    assert sorted((r[0] or -1, *r[1:]) for r in token_counts(docs).collect()) == wanted
    assert any(w[3] for w in wanted)


def test_empty_table(spark):
    assert token_counts(none(documents(spark))).count() == 0


def test_batches_are_equal_in_bytes_but_for_a_piece(monkeypatch):
    monkeypatch.setattr(tokens, "PIECE_BYTES", 200)
    monkeypatch.setattr(tokens, "BATCH_BYTES", 1000)
    dice = random.Random(4)
    texts = ["日本 é word " * dice.choice([0, 1, 5, 300]) for _ in range(80)] + ["x" * 90, "", "日" * 60]
    found = []
    batches = list(Encoder().batches(texts, found))
    size = lambda piece: len(piece.encode())
    assert found == [0] * len(texts)
    for batch in batches[:-1]:
        sizes = [size(p) for _, p in batch]
        assert 1000 <= sum(sizes) < 1000 + sizes[-1]
    pieces = [size(p) for batch in batches for _, p in batch]
    assert max(pieces) < 230  # cut at the first blank between words
    joined = {}
    for batch in batches:
        for i, piece in batch:
            joined.setdefault(i, []).append(piece)
    assert {i: " ".join(p) for i, p in joined.items()} == {i: t for i, t in enumerate(texts) if t}

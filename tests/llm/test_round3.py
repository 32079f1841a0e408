"""What the third round's findings asked for."""

import random
import tracemalloc

import numpy as np

from evimatch.llm import quality, tokens
from evimatch.operators import merging


def test_training_holds_one_row_on_the_driver(spark):
    """400 texts of 2,000 words: their n-grams take over 70 MB at eight bytes each, the weights 26 MB."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(3, 9)))
    docs = spark.createDataFrame([(i, ("good " if i % 2 else "bad ") * 40 + " ".join(word() for _ in range(2_000))) for i in range(400)], "doc_id long, text string").repartition(8)
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")
    docs.count()
    tracemalloc.start()
    try:
        model = quality.train(docs, labels)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert model is not None and peak < 80e6, peak


def test_tasks_of_a_worker_share_the_tokenizer():
    """Loading it took a twentieth of a task's CPU seconds; the remembered words go with the task."""
    one, other = (tokens.Encoder(tokens.vocabulary(), kind) for kind in ("uint16", "uint32"))
    assert one.tokenizer is other.tokenizer and one.words is not other.words and one.short


def test_accented_and_cased_words_equal_the_library():
    rng, e = random.Random(8), tokens.Encoder(tokens.vocabulary(), "uint32")
    signs = "".join(chr(i) for i in range(0x41, 0x100) if chr(i).isalpha()) + "n'.," * 6
    for _ in range(3000):
        w = "".join(rng.choice(signs) for _ in range(rng.randrange(1, 9)))
        s = " ".join((w, w.lower(), w.upper(), w.lower(), "Plain", "plain", "PLAIN"))
        assert np.frombuffer(e.encode([s.encode()])[0], dtype="uint32").tolist() == e.tokenizer.encode(s, add_special_tokens=False).ids


def test_names_are_compared_in_whole(spark):
    """What test_combine_names_compares_whole_texts asks, of the operator: its query reads other tables now."""
    start = "The same long beginning of "
    names = [(1, "front", start + "one story about rivers"), (1, "back", start + "another tale, with quite different words"), (2, "front", start + "a third story"), (2, "back", start + "a third  story!")]
    rows = [(card, side, 0, text, 0.8, 0.5) for card, side, text in names]
    got = merging.combine_names(spark.createDataFrame(rows, "card_id long, side string, pos int, text string, confidence double, score double")).collect()
    assert {(r.card_id, r.agreed) for r in got} == {(1, False), (2, True)} and {r.text for r in got if r.card_id == 1} == {names[0][2], names[1][2]}

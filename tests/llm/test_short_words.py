"""The pipeline's stage of repeated passages on passages of just over fifty short words."""

import random

import corpus_pipeline


def test_fifty_one_short_words(spark, make_docs):
    rnd = random.Random(6)
    text = lambda n, least, most: " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(least, most))) for _ in range(n))
    out, planted = [], []
    # At any offset; 51 words of one letter have 101 bytes, fifty words are too few.
    for k, (n, least, most) in enumerate([(51, 1, 1), (51, 1, 3), (51, 3, 3), (60, 1, 3), (51, 8, 9), (50, 1, 3)]):
        passage = text(n, least, most)
        planted.append(passage)
        out += [f"{text(7 * k, 2, 9)} X {passage} Y {text(40 - k, 2, 9)}", f"{text(90, 2, 9)} Z {passage} Q"]
    rows = {r.doc_id: r.text for r in corpus_pipeline.repeated_passages(spark, make_docs([*out, None, ""]), "").collect()}
    for k, passage in enumerate(planted):
        for i in (2 * k, 2 * k + 1):
            # Long words are cut by their bytes, with the spaces around them.
            gone = out[i] if k == 5 else out[i].replace(passage, "")
            assert rows[i].replace(" ", "") == gone.replace(" ", ""), (k, i)
    assert rows[12] is None and rows[13] == ""


def test_window_that_overlaps_itself(spark, make_docs):
    rows = {r.doc_id: r.text for r in corpus_pipeline.repeated_passages(spark, make_docs(["a " * 52 + "end", "b " * 51 + "end"]), "").collect()}
    assert rows == {0: " end", 1: "b " * 51 + "end"}

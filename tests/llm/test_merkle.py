import hashlib
import zlib

import pytest

from lapspark.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, pos string, digest string, _at string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, lower=False):
    text = row[1]
    if lower and text is not None:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    parts = [row[0], row[3], row[2], row[4], text]
    return h(*("-" if p is None else f"{len(str(p).encode())}:{p}" for p in parts))


def climb(nodes, place=None, value=None):
    """Root, siblings of ``place`` from below, and the root with ``value`` at ``place``."""
    proof = []
    while len(nodes) > 1:
        runs = [nodes[k:k + 8] for k in range(0, len(nodes), 8)]
        if place is not None:
            run, slot = runs[place // 8], place % 8
            proof += run[:slot] + run[slot + 1:]
            value = h(*run[:slot], value, *run[slot + 1:])
            place //= 8
        nodes = [h(*run) for run in runs]
    return nodes[0], proof, value


def expected(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = {
        lang: sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for lang in langs
    }
    subroots = [climb([leaf(r) for r in groups[lang]])[0] for lang in langs]
    root = climb(subroots)[0] if rows else None
    out = []
    for k, lang in enumerate(langs):
        nodes = [leaf(r) for r in groups[lang]]
        for place, row in enumerate(groups[lang]):
            tamper = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
            _, below, value = climb(nodes, place, leaf(row, tamper))
            _, above, value = climb(subroots, k, value)
            out.append((row[0], nodes[place], subroots[k], root, h(*below, *above), value, value == root))
    return sorted(out, key=repr)


def found(spark, rows, **options):
    frame = merkle.manifest(spark.createDataFrame([(*r, "k", "p", "d", "a") for r in rows], SCHEMA), **options)
    assert frame.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, frame.collect()), key=repr)


def rows_of(n, lang):
    return [(7 * i % 1009, f"Text {i} of {lang}", lang, f"s{i % 3}" if i % 5 else None, i) for i in range(n)]


@pytest.mark.parametrize("counts", [{"en": 1}, {"en": 8, "de": 9}, {"en": 65, None: 1, "de": 64, "fr": 7}])
def test_small_trees(spark, counts):
    rows = [r for lang, n in counts.items() for r in rows_of(n, lang)]
    assert found(spark, rows) == expected(rows)


def test_trees_of_several_rounds(spark):
    rows = rows_of(600, "en") + rows_of(73, "de") + [r for k in range(11) for r in rows_of(1, f"x{k}")]
    assert found(spark, rows, levels=1) == expected(rows)


def test_odd_rows(spark, odd_texts):
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "", None) for i, t in enumerate(odd_texts)]
    rows += [(None, "A", "en", "s", 1), (None, "B", "en", "s", 1), (3, "Same", "É", "s", 4), (3, "Same", "É", "s", 4), (3, "Other", "É", "s", 5)]
    assert found(spark, rows) == expected(rows)


def test_no_rows(spark):
    assert found(spark, []) == []


def test_a_parent_resumes_from_any_slot():
    children = [h(str(k)).encode() for k in range(8)]
    parent = merkle.Parent(children)
    for slot in range(8):
        changed = [*children[:slot], b"f" * 64, *children[slot + 1:]]
        assert merkle.resumed(parent.midstates[slot], b"f" * 64, parent.right(slot)) == merkle.Parent(changed).digest
        assert merkle.resumed(parent.midstates[slot], children[slot], parent.right(slot)) == parent.digest

"""What op9 adds to the base spans: planted data is found, what fails a test is not."""

import random

import pytest
from brute import luhn

from hetweave.llm import pii


@pytest.fixture(scope="module")
def planted():
    """Texts with wrong and right card numbers, addresses written out, local phone numbers, secrets and plain numbers."""
    rng = random.Random(4)
    rows, want = [], set()

    def number(right):
        while True:
            d = "4" + "".join(rng.choice("0123456789") for _ in range(15))
            if luhn(d) == right:
                return d

    for k in range(120):
        kind = k % 6
        word = ["order", "seen", "value", "near"][k % 4]
        secret = "".join(rng.choice("abcdefgh01234567") for _ in range(24)) + "a1"
        put = [number(False), number(True), f"jane{k} [at] example [dot] com", f"(555) 555-{1000 + k}", f"token={secret}", str(10**5 + k)][kind]
        text = f"{word} {put} end of it"
        if kind in (2, 3):
            want.add((k, ("email", None, None, "phone")[0 if kind == 2 else 3], len(word) + 1))
        if kind == 4:
            want.add((k, "secret", len(word) + 7))
        rows.append((k, text))
    return rows, want


def test_added_spans(spark, planted):
    rows, want = planted
    found = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"))
    added, cards = set(), set()
    for r in found.collect():
        base = {tuple(s) for s in r.base}
        added |= {(r.doc_id, pii.KINDS[s.k], s.start) for s in r.spans if tuple(s) not in base}
        cards |= {r.doc_id for s in r.spans if pii.KINDS[s.k] == "card"}
    assert cards == {k for k in range(120) if k % 6 == 1}  # the right ones, which are base spans
    assert added <= want
    for kind in ("email", "phone", "secret"):
        of = {w for w in want if w[1] == kind}
        assert len(added & of) >= 0.9 * len(of), kind


def test_a_wrong_checksum_is_proof():
    """Labelers that agree on spans of a wrong checksum don't make them data."""
    counts = {(2, (-1, 1, 0, 1, 1)): 150, (2, (1, 1, 0, 1, 1)): 5, (2, (-1, -1, 0, 1, 1)): 100}
    chance = pii.label_model(counts)
    assert chance[2, (-1, 1, 0, 1, 1)] == chance[2, (-1, -1, 0, 1, 1)] == 0 < chance[2, (1, 1, 0, 1, 1)]

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASHES = ("simhash", "score", "contamination", "main_text", "kept_id", "mix_s", "mix", "t", "i", "e", "u", "active", "list_0", "component")


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghé") for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with copies, near copies, nulls, empties, repeated rows and a very long text."""
    rng = random.Random(5)
    out, base = [], sentence(rng, 120)
    for k in range(60):
        out.append((k, sentence(rng, rng.randint(1, 80)), "en", f"s{k % 4}", k))
    out += [(100 + k, base, "en", "s0", 1) for k in range(12)]
    near = base.split(" ")
    for k in range(8):
        near[rng.randrange(len(near))] = "changed"
        out.append((200 + k, " ".join(near), None, "s0", None))
    out += [(300, None, None, None, None), (301, "", "en", "s1", 0), (302, " \t\n", "en", "s1", 3), (303, "One", "en", None, 3), (303, "One", "en", None, 3), (None, "no id here", "en", "s2", 9), (None, None, None, None, None)]
    out.append((400, sentence(rng, 30_000), "en", "s3", 1))
    out.append((401, "MIXED Case, text: " + base.upper(), "en", "s3", 1))
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def wide(docs):
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit("mine") for c in CLASHES})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)

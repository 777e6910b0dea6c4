import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty texts, repeated rows, ties, a very long text, and columns with clashing names."""
    long = " ".join(f"w{i % 997} x{i}" for i in range(30_000))
    line = "a line of more than twenty characters"
    rows = [
        (1, None, "en", None),
        (2, "", None, 5),
        (None, f"no number at all\n{line}", "de", 1),
        (3, " \t\n ", "fr", 2),
        (4, "one", "en", 3),
        (5, long, "en", 4),
        (5, long, "en", 4),
        (6, f"{line}\n  A LINE of more than twenty characters \nown words here", "en", 6),
        (7, f"{line}\n{line}", "en", 7),
        (8, f"x\n{line}\ny", "en", 8),
        (9, "ÄÖÜ ß é 中文 😀 mail a.b@c.de now", "xx", 9),
        (10, "one", "en", 10),
    ]
    return spark.createDataFrame(
        [(*r, 1.5, "k", "h", 0, 7, 8, "s", 9, "b", "r", "c", "t") for r in rows],
        "doc_id long, text string, lang string, n_chars long, score double, keep string,"
        " hits string, n int, _doc int, _hash int, _spans string, _kept_doc int, _keep_bitmap string,"
        " _row string, _cut string, _text string",
    )


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)

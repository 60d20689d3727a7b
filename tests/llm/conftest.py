import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

#: Null, empty and blank texts, ties, repeated rows and a long text; every operator must take them all.
LONG = " ".join(f"w{i % 977}x{i}" for i in range(6000))
BASE = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf in the dark forest near the river bank at night"
TEXTS = {
    1: BASE, 2: BASE, 3: BASE.replace("quick", "slow"), 4: None, 5: "", 6: "  \n\t ", 7: "one", 8: "two words", 9: LONG, 10: LONG + " tail", 11: "a line here that is long enough\nshared line number one two three\nlast", 12: "shared line number one two three\nother",
    13: "Größe ß écrit ▁ 日本 \U0001f600 tab\tend", 14: "x" * 300, 15: "shared line number one two thrae\nend",
}


@pytest.fixture(scope="session")
def edge(spark):
    """Documents with the cases above, a null id, a repeated row, and extra columns whose names operators use themselves."""
    rows = [(i, t, "en" if i % 3 else None, f"src{i % 2}", len(t or ""), i, "k", i) for i, t in TEXTS.items()] + [(None, "no id at all in this row", "en", "s", 24, 0, "k", 0), (2, TEXTS[2], "en", "src0", 10, 2, "k", 2)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, key string, row bigint").repartition(3)


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)

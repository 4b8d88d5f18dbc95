import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

LONG = " ".join(f"w{i % 997}x{i % 13}" for i in range(30000))
#: doc_id, text: nulls, blanks, a very long text, exact copies, repeated rows, a row without id.
EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, LONG + " tail"), (6, "one two"), (7, "one two"), (8, "One  TWO"), (8, "One  TWO"), (None, "one two"), (9, "é\u0301 \U0001f600 <|endoftext|> x")]


@pytest.fixture(scope="session")
def edge(spark):
    """Edge cases with columns whose names clash with inner ones."""
    df = spark.createDataFrame(EDGE, "doc_id long, text string")
    return df.selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "1L as n_chars", "doc_id as rep", "text as words", "1 as node", "doc_id as id", "'x' as tag")


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.where("false")

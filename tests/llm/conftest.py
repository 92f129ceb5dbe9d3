import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from llm_data import SCHEMA, make  # noqa: E402


@pytest.fixture(scope="session")
def edge_rows():
    line = "Some shared line of words here."
    body = " ".join(f"word{k} and Other{k % 7}, thing." for k in range(60))
    near = body.replace("word30", "wort30")
    return [
        (1, f"{line}\n{body}", "en", "a"),
        (2, f"  {line.upper()} \n{near}", "en", "a"),
        (3, None, "en", None),
        (4, "", None, "b"),
        (5, "   \n \t ", "de", "b"),
        (6, "one", "de", "b"),
        (7, f"x\n{line}\ny", "en", "c"),
        (7, f"x\n{line}\ny", "en", "c"),
        (None, f"{line}\nlast", None, "c"),
        (8, body + "\n" + " ".join(f"long{k % 1000}" for k in range(30000)), "fr", "a"),
        (9, "Released under the MIT License. All rights reserved.\nCC BY 4.0 and cc-by", "fr", "ü"),
        (10, "a b c d e f g h " * 30, "fr", "ü"),
        (11, body, "en", "a"),
        (12, body, "en", "a"),
    ]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return make(spark, edge_rows).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)

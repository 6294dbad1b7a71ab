"""The OpenAPI document as YAML."""

import json

import pytest
from pyspark.sql import functions as F

from quillspan.functions import url as U
from quillspan.operators import classify, dedup, document

EXPECTED = """components:
    schemas:
        LoginResponse:
            properties:
                "404":
                    type: string
                'a: b':
                    type: number
            type: object
info:
    title: localhost:1 API
    version: 1.0.0
openapi: 3.0.3
paths:
    /api/login:
        get:
            responses:
                "200":
                    content:
                        application/json:
                            schema:
                                $ref: '#/components/schemas/LoginResponse'
                    description: OK
                "503":
                    description: Service Unavailable
            summary: Get /api/login
servers:
    - url: http://localhost:1
"""


@pytest.mark.parametrize(
    ("value", "shown"),
    [("x", "x"), ("200", '"200"'), ("1.0.0", "1.0.0"), ("true", '"true"'), ("", '""'), ("#/a", "'#/a'"), ("it's: so", "'it''s: so'"), ("a\nb", '"a\\nb"'), ("- a", "'- a'"), ("*", "'*'"), (True, "true"), (1.5, "1.5"), (None, "null"), ("2024-01-02", '"2024-01-02"'), ("é", "'é'")],
)
def test_scalars(value, shown):
    assert document._scalar(value) == shown


def test_levels():
    made = document._yaml({"a": [{"b": {"c": 1}, "d": [2, []]}, "x"], "e": {}}, 0)
    assert made == ["a:", "    - b:", "        c: 1", "      d:", "        - 2", "        - []", "    - x", "e: {}"]


def test_document(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    answer = json.dumps({"a: b": 1.5, "404": "x"})
    rows = [(0, 200, answer), (1, 503, None)]
    made = spark.createDataFrame(rows, "seq long, status int, answer string").select(
        "seq", F.lit("GET").alias("method"), F.lit("http://localhost:1/api/login").alias("url"), F.create_map().cast("map<string,string>").alias("headers"), U.query_params(F.lit("http://x/")).alias("query_params"), F.lit(None).cast("binary").alias("body"),
        F.struct(F.col("status").alias("status_code"), F.create_map().cast("map<string,string>").alias("headers"), F.lit("application/json").alias("content_type"), F.col("answer").cast("binary").alias("body")).alias("response"),
        F.lit("browser").alias("source"), F.lit("").alias("tag"), F.lit("").alias("attribute"), F.lit("").alias("page_url"),
    )
    assert document.yaml_document(classify.classify(made, ["rest"])).collect()[0]["yaml"] == EXPECTED

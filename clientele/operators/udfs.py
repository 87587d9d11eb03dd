"""The Python surface (U2): a pluggable model function over Arrow batches; Spark
partitions the work, Python only sees one batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T


# ---------------------------------------------------------------------------
# Pluggable model step
# ---------------------------------------------------------------------------

ReplyFn = Callable[[pd.DataFrame], pd.Series]


def complete(requests: DataFrame, fn: ReplyFn, id_col: str = "request_id",
             body_col: str = "body") -> DataFrame:
    """Run ``fn`` over request batches (``mapInPandas``); returns
    ``id_col, http_status, reply_body``.  ``fn`` receives a pandas frame with
    the two columns and returns the reply bodies (JSON envelopes) in order;
    a failure of one batch marks its rows with status 0 instead of failing
    the job."""
    schema = T.StructType([requests.schema[id_col], T.StructField("http_status", T.IntegerType()),
                           T.StructField("reply_body", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            try:
                bodies = pd.Series(fn(pdf[[id_col, body_col]]), index=pdf.index).astype(object)
                status = 200
            except Exception as e:  # noqa: BLE001 -- reported per row, the job goes on
                bodies = pd.Series([f"request failed: {e}"] * len(pdf), index=pdf.index, dtype=object)
                status = 0
            yield pd.DataFrame({id_col: pdf[id_col], "http_status": status, "reply_body": bodies})
    return requests.select(id_col, body_col).mapInPandas(run, schema)


def replies_from_table(requests: DataFrame, responses: DataFrame, id_col: str = "request_id") -> DataFrame:
    """U2 default / J6: replies already materialised in a table, joined on the
    request id; a request without a reply gets status 0 and an error body."""
    r = responses.select(F.col("reply_id").alias(id_col), "http_status", F.col("body").alias("reply_body"))
    j = requests.join(r, id_col, "left")
    return j.select(id_col,
                    F.coalesce("http_status", F.lit(0)).alias("http_status"),
                    F.coalesce("reply_body", F.lit("no reply")).alias("reply_body"),
                    F.col("http_status").isNotNull().alias("has_reply"))


def echo_model(pdf: pd.DataFrame) -> list[str]:
    """Deterministic stand-in model for tests and offline runs: replies with
    the name the request is about as a one-client JSON document, fenced the
    way hosted models often answer."""
    import json
    out = []
    for body in pdf["body"]:
        prompt = json.loads(body)["messages"][0]["content"]
        name = prompt.split(" about ", 1)[-1].split(" (", 1)[0]
        reply = "```json\n" + json.dumps({"clients": [{"name": name}]}) + "\n```"
        out.append(json.dumps({"content": [{"type": "text", "text": reply}]}))
    return out

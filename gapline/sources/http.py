"""The feedback service: a batch stage that asks it for texts, and its health probe."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame

TIMEOUT_S, PROBE_S = 180, 5
IN_FLIGHT, ATTEMPTS, PAUSE_S = 8, 3, 0.2


def _ask(url: str, body: str, timeout: float, attempts: int) -> tuple[str | None, str | None]:
    """(feedback, error) of one request; busy and failing servers are asked again after a pause that doubles."""
    ask = urllib.request.Request(f"{url.rstrip('/')}/feedback", body.encode(), {"Content-Type": "application/json"})
    for left in range(attempts - 1, -1, -1):
        try:
            with urllib.request.urlopen(ask, timeout=timeout) as answer:
                return json.load(answer)["feedback"], None
        except (OSError, ValueError, KeyError) as e:
            final = isinstance(e, (ValueError, KeyError)) or (isinstance(e, urllib.error.HTTPError) and e.code < 500 and e.code != 429)
            if final or not left:
                return None, f"{type(e).__name__}: {e}"
            time.sleep(PAUSE_S * 2 ** (attempts - 1 - left))
    return None, "no attempt"


def request_feedback(requests: DataFrame, url: str, timeout: float = TIMEOUT_S, in_flight: int = IN_FLIGHT, attempts: int = ATTEMPTS) -> DataFrame:
    """(pair_id, feedback, error) of requests (pair_id, body), body the JSON of a request. A task keeps `in_flight`
    requests open at a time, each made `attempts` times at most. One row's failure is that row's error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(in_flight) as pool:
            for rows in batches:
                answers = list(pool.map(lambda body: (None, "no body") if body is None else _ask(url, body, timeout, attempts), rows["body"]))
                yield pd.DataFrame({"pair_id": rows["pair_id"], "feedback": [f for f, _ in answers], "error": [e for _, e in answers]})

    kind = requests.schema["pair_id"].dataType.simpleString()
    return requests.select("pair_id", "body").mapInPandas(run, f"pair_id {kind}, feedback string, error string")


def healthy(url: str, timeout: float = PROBE_S) -> bool:
    try:
        with urllib.request.urlopen(f"{url.rstrip('/')}/health", timeout=timeout) as answer:
            return answer.status == 200
    except (OSError, ValueError):
        return False

"""Pages and files behind addresses, fetched by the executors.

A row is an address, the result a row again whatever happened, so one failing
address never fails a job.  Failures that may mend are tried again after a pause
that grows.  What is in a cache isn't asked for: ``missing`` leaves it out.
"""

from __future__ import annotations

import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deckweave.functions import urls as U
from deckweave.operators.reports import TRANSIENT

SHAPE = "url string, status int, final_url string, body binary, error string, signed_out boolean"
#: Connections that were lost or took too long; one that is refused isn't tried again.
LOST = (ConnectionResetError, ConnectionAbortedError, BrokenPipeError, TimeoutError)
# Marks of a page that asks for a sign-in.
SIGN_IN_BODY = "(?i)login\\.microsoftonline\\.com|name=\"loginfmt\"|\"urlMsaLogout\""


def read_url(url: str, headers: dict[str, str], seconds: float, attempts: int, pause: Callable[[float], None] = time.sleep) -> dict:
    """One address: status, where it led, body, error; tried again on a status or message that may mend."""
    out: dict = {"url": url, "status": None, "final_url": None, "body": None, "error": None, "signed_out": False}
    for attempt in range(1, attempts + 1):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=seconds) as response:
                body = response.read()
                lost = bool(re.search(U.SIGN_IN, response.url)) or bool(re.search(SIGN_IN_BODY.encode(), body))
                return out | {"status": response.status, "final_url": response.url, "body": body, "error": None, "signed_out": lost}
        except urllib.error.HTTPError as error:
            out |= {"status": error.code, "error": f"HTTP {error.code}"}
            again = error.code in U.TRY_AGAIN
        except (OSError, ValueError) as error:
            out |= {"status": None, "error": str(error) or type(error).__name__}
            cause = getattr(error, "reason", error)
            again = isinstance(cause, LOST) or bool(re.search(TRANSIENT, str(error)))
        if not again or attempt == attempts:
            return out
        pause(attempt)
    return out


def fetch(requests: DataFrame, url: str = "url", headers: dict[str, str] | None = None, seconds: float = 45, attempts: int = 3) -> DataFrame:
    """(url, status, final_url, body, error, signed_out) of each distinct address; nulls are left out."""
    sent = headers or {}

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for address in pdf["url"]:
                yield pd.DataFrame([read_url(address, sent, seconds, attempts)]).astype({"status": "Int32"})

    return requests.select(F.col(url).alias("url")).where("url IS NOT NULL").distinct().mapInPandas(work, SHAPE)


def missing(requests: DataFrame, cached: DataFrame, url: str = "url") -> DataFrame:
    """Requests whose address isn't cached."""
    return requests.join(cached.select(url).distinct(), url, "left_anti")


def text(fetched: DataFrame) -> DataFrame:
    """(url, html, failed): bodies as text; failures and pages that ask for a sign-in have none."""
    fine = F.col("error").isNull() & ~F.col("signed_out") & F.col("status").between(200, 299)
    return fetched.select("url", F.when(fine, F.make_valid_utf8(F.col("body").cast("string"))).alias("html"), (~fine).alias("failed"))

"""Pages of the network, fetched by the executors: a bound of requests for each host, retries with growing pauses."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AGENT = "Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0 Safari/537.36"
#: Requests that a host gets at a time, tries for a page, the first pause and the longest wait for an answer, in seconds.
PER_HOST, TRIES, PAUSE, TIMEOUT = 2, 4, 0.5, 30.0
#: Answers after which another try may succeed.
PASSING = frozenset({408, 425, 429, 500, 502, 503, 504})


def fetch(url: str, timeout: float = TIMEOUT) -> str:
    """A page's text, asked for with a browser's name."""
    with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": AGENT}), timeout=timeout) as answer:
        charset = answer.headers.get_content_charset() or "utf-8"
        return answer.read().decode(charset, "replace")


def fetch_again(url: str, tries: int = TRIES, pause: float = PAUSE, timeout: float = TIMEOUT, wait: Callable[[float], None] = time.sleep) -> tuple[str | None, str | None, int]:
    """(text, error, tries taken): an answer that won't change, as 404, isn't asked for again."""
    error = None
    for k in range(1, tries + 1):
        try:
            return fetch(url, timeout), None, k
        except urllib.error.HTTPError as e:
            error = f"{e.code} {e.reason}"
            if e.code not in PASSING:
                return None, error, k
        except (OSError, ValueError) as e:
            error = str(e) or type(e).__name__
            if isinstance(e, ValueError):
                return None, error, k
        if k < tries:
            wait(pause * 2 ** (k - 1))
    return None, error, tries


def fetch_pages(listed: DataFrame, url: str = "url", per_host: int = PER_HOST, tries: int = TRIES, pause: float = PAUSE, timeout: float = TIMEOUT) -> DataFrame:
    """The rows with content, error and tries of the page at `url`; one page's failure leaves the others alone.

    The addresses of a host are dealt to `per_host` places, each of which asks
    for its pages one after another, so a host never gets more requests at a
    time, however many cores there are; hosts are asked side by side.  A null
    address has neither content nor error.
    """
    host = F.coalesce(F.lower(F.try_parse_url(F.col(url), F.lit("HOST"))), F.lit(""))
    dealt = listed.withColumns({"__host": host, "__slot": F.pmod(F.xxhash64(url), F.lit(per_host))}).repartition("__host", "__slot").drop("__host", "__slot")
    at = listed.columns.index(url)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, address in enumerate(batch.column(at).to_pylist()):
                content, error, k = fetch_again(address, tries, pause, timeout) if address is not None else (None, None, 0)
                row = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([content], pa.string()), pa.array([error], pa.string()), pa.array([k], pa.int32())], [*row.schema.names, "content", "error", "tries"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in listed.schema.fields)
    return dealt.mapInArrow(run, f"{fields}, content string, error string, tries int")


def or_raise(pages: DataFrame, url: str = "url") -> DataFrame:
    """The pages; the query fails on one that couldn't be fetched."""
    failed = F.raise_error(F.concat(F.lit("can't fetch "), F.col(url), F.lit(": "), F.col("error"))).cast("string")
    return pages.withColumn("content", F.when(F.col("error").isNotNull(), failed).otherwise(F.col("content")))

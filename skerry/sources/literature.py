"""A literature service: a client with throttle and retries, a search as a Spark data source, cached fetches.

The service limits the calls of a key, whatever machines they come from.  So work on it is dealt to a fixed
number of *lanes*, partitions of which each has its part of the rate: all of them running at once keep
the limit.  A task that runs twice at the same time (speculation) would add its lane's part once more.
"""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from skerry import workspace
from skerry.operators import models, ordering
from skerry.operators.answers import Answers
from skerry.sources import articles

# The service's limits in calls a second, without and with a key, and its largest page.
RATE, RATE_WITH_KEY = 3, 10
PAGE = 10_000
ATTEMPTS, FIRST_WAIT, LONGEST_WAIT = 5, 2.0, 30.0
BATCH = 200
LANES = 3
#: Batches that a lane fetches in one job; a job that fails loses those of its unfinished lanes.
BATCHES_PER_JOB = 50


def lane_rate(key: str, lanes: int) -> int:
    """The whole calls a second that each of ``lanes`` may make, so no second has more than the limit over all of them."""
    rate = RATE_WITH_KEY if key else RATE
    if not 1 <= lanes <= rate:
        raise ValueError(f"{rate} calls a second can be dealt to 1 to {rate} lanes")
    return rate // lanes


class Client:
    """Requests of one lane: calls keep their distance in time, failed ones are repeated, as calls that count."""

    def __init__(self, endpoint: str, key: str = "", clock=time.monotonic, sleep=time.sleep, opener: Callable[[str], bytes] | None = None, lanes: int = 1):
        self.endpoint, self.key, self._clock, self._sleep = endpoint.rstrip("/"), key, clock, sleep
        self._distance, self._next = 1 / lane_rate(key, lanes), float("-inf")
        self._open = opener or self._http
        self.request = models.retried(self._once, ATTEMPTS, FIRST_WAIT, LONGEST_WAIT, sleep=sleep)

    @staticmethod
    def _http(url: str) -> bytes:
        with urllib.request.urlopen(url, timeout=60) as answer:  # an HTTP error is an OSError
            return answer.read()

    def _once(self, path: str, **parameters: str) -> bytes:
        early = self._next - self._clock()
        if early > 0:
            self._sleep(early)
        self._next = self._clock() + self._distance
        extra = {"api_key": self.key} if self.key else {}
        return self._open(f"{self.endpoint}/{path}?{urllib.parse.urlencode(parameters | extra)}")

    def _found(self, query: str, most: int, start: int) -> dict:
        return json.loads(self.request("esearch.fcgi", db="pmc", term=query, retstart=str(start), retmax=str(most), retmode="json"))["esearchresult"]

    def search(self, query: str, most: int, start: int = 0) -> list[str]:
        return list(self._found(query, most, start)["idlist"])

    def count(self, query: str) -> int:
        """How many records a search finds in all."""
        return int(self._found(query, 0, 0)["count"])

    def fetch(self, ids: list[str], db: str = "pmc") -> bytes:
        return self.request("efetch.fcgi", db=db, id=",".join(ids), retmode="xml")


class _Lane(InputPartition):
    """Pages, (start, size) each, that one task reads one after another."""

    def __init__(self, pages: list[tuple[int, int]], lanes: int):
        super().__init__(pages)
        self.pages, self.lanes = pages, lanes


class _Pages:
    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}
        self.size = int(self.options.get("page", PAGE))

    def _lanes(self, start: int, end: int) -> list[_Lane]:
        pages = [(k, min(self.size, end - k)) for k in range(start, end, self.size)]
        lanes = min(len(pages), int(self.options.get("lanes", LANES)))
        return [_Lane(pages[k::lanes], lanes) for k in range(lanes)]

    def _client(self, lanes: int = 1) -> Client:
        return Client(self.options["endpoint"], self.options.get("key", ""), lanes=lanes)

    def read(self, partition: _Lane) -> Iterator[tuple[int, str]]:
        client = self._client(partition.lanes)
        for start, size in partition.pages:
            for k, number in enumerate(client.search(self.options["query"], size, start)):
                yield start + k, number


class _SearchReader(_Pages, DataSourceReader):
    def partitions(self) -> list[_Lane]:
        return self._lanes(0, int(self.options["most"]))


class _SearchStream(_Pages, DataSourceStreamReader):
    """Offsets are numbers of records: a restart goes on after the last batch that was taken whole."""

    def initialOffset(self) -> dict:
        return {"records": 0}

    def latestOffset(self) -> dict:
        found = self._client().count(self.options["query"])
        return {"records": min(found, int(self.options["most"])) if "most" in self.options else found}

    def partitions(self, start: dict, end: dict) -> list[_Lane]:
        return self._lanes(start["records"], max(start["records"], end["records"]))


class Search(DataSource):
    """``format("literature_search")`` with endpoint, query and, if there are any, key, most, page, lanes: position, pmcid.

    A batch read takes the first ``most`` records; a stream takes all that have come, then what comes on top.
    """

    @classmethod
    def name(cls) -> str:
        return "literature_search"

    def schema(self) -> str:
        return "position long, pmcid string"

    def reader(self, schema) -> DataSourceReader:
        return _SearchReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _SearchStream(self.options)


def batched(ids: DataFrame, column: str, fetch: Callable[[list[str]], Iterator[tuple]], schema: str, keep: Callable[[DataFrame], None], batch: int = BATCH, lanes: int = LANES, per_job: int = BATCHES_PER_JOB) -> int:
    """Ask ``fetch`` for all ``ids`` in full batches, by jobs of ``lanes`` tasks; each job's rows go to ``keep``.  The number of calls.

    Batches come of numbers in the order of the ids, so they are full but for the last one, however the
    ids were dealt to partitions.
    """
    numbered = ordering.numbered(ids.select(column).filter(F.col(column).isNotNull()).distinct(), [column])
    numbered = workspace.materialize(numbered.withColumn("batch", F.expr(f"number div {batch}")), "batches")
    calls = -(-numbered.count() // batch)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in schema.split(", ")]
        now, held = None, []
        for part in parts:
            for number, value in zip(part["batch"], part[column]):
                if held and number != now:
                    yield pd.DataFrame(list(fetch(held)), columns=names)
                    held = []
                now = number
                held.append(value)
        if held:
            yield pd.DataFrame(list(fetch(held)), columns=names)

    for first in range(0, calls, lanes * per_job):
        some = numbered.filter(F.col("batch").between(first, first + lanes * per_job - 1)).withColumn("lane", F.col("batch") % lanes)
        keep(some.repartition(lanes, "lane").sortWithinPartitions("batch").mapInPandas(run, schema))
    workspace.release(numbered)
    return calls


def fetched(wanted: DataFrame, cache: str, fetch: Callable[[list[str]], dict[str, bytes]], batch: int = BATCH, lanes: int = LANES) -> DataFrame:
    """(pmcid) to pmcid, content, cached: what the cache lacks is fetched once per identifier and put there.

    Records that the service doesn't give are left out and asked for again the next time.
    """
    kept = Answers(wanted.sparkSession, cache, "content binary", "pmcid")
    before = workspace.materialize(kept.found(wanted).select("pmcid"), "cached")
    batched(kept.missing(wanted.select("pmcid")), "pmcid", lambda ids: fetch(ids).items(), "pmcid string, content binary", kept.add, batch, lanes)
    out = kept.found(wanted)
    return out.join(before.withColumn("cached", F.lit(True)), "pmcid", "left").withColumn("cached", F.coalesce("cached", F.lit(False)))


def collected(wanted: DataFrame, cache: str, fetch: Callable[[list[str]], dict[str, bytes]], citations: Callable[[list[str]], bytes], batch: int = BATCH, lanes: int = LANES) -> DataFrame:
    """Papers of (pmcid), with their citations' subjects and dates, ``cached`` and ``place``: cached ones first, each in order of pmcid.

    Records come from the cache or the service; citations are asked for anew each time, in batches by pmid.
    """
    records = fetched(wanted, cache, fetch, batch, lanes)
    parsed = articles.parse_files(records.select(F.col("pmcid").alias("path"), "content"))
    parsed = workspace.materialize(parsed.filter("error is null"), "parsed")
    parts: list[DataFrame] = []
    batched(parsed, "pmid", lambda ids: [(ids[0], citations(ids))], "path string, content binary", lambda rows: parts.append(workspace.materialize(rows, "citations")), batch, lanes)
    files = parts[0] if parts else wanted.sparkSession.createDataFrame([], "path string, content binary")
    for more in parts[1:]:
        files = files.unionByName(more)
    papers = articles.enriched(articles.papers(parsed), articles.read_citations(files))
    came = parsed.select("pmid", F.col("path").alias("pmcid")).join(records.select("pmcid", "cached"), "pmcid")
    papers = papers.join(came, "pmid")
    places = ordering.numbered(came.select("pmid", "cached", "pmcid"), [F.desc("cached"), "pmcid"], "place").select("pmcid", "place")
    return papers.join(places, "pmcid")

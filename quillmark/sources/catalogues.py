"""Remote catalogues as a data source: one partition a request, entries parsed from what it gives. What carries a request out is given by the caller: the network, or
a folder of saved answers.

    spark.dataSource.register(CatalogueSource)
    spark.read.format("catalogue").option("catalogue", "arxiv").option("pages", "cs.CL,cs.IR").option("size", 50).option("folder", saved).load()
"""

from __future__ import annotations

import hashlib
import importlib
import json
import time
import urllib.parse
import urllib.request
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Entry = tuple[str, str, str, str]  # id, url, format, title or package


def quoted(text: str) -> str:
    return urllib.parse.quote(text, safe="")


# The addresses of the services and what their answers look like.
def arxiv_entries(page: str, answer: bytes) -> Iterator[Entry]:
    atom = "{http://www.w3.org/2005/Atom}"
    for e in ET.fromstring(answer).iter(f"{atom}entry"):
        name = (e.findtext(f"{atom}id") or "").rpartition("/")[2]
        if name:
            yield name, f"https://arxiv.org/pdf/{name}.pdf", "pdf", " ".join((e.findtext(f"{atom}title") or "").split())


def sec_entries(page: str, answer: bytes) -> Iterator[Entry]:
    """The newest annual report of a company."""
    recent = json.loads(answer).get("filings", {}).get("recent", {})
    filings = zip(*(recent.get(k, []) for k in ("form", "accessionNumber", "primaryDocument")))
    annual = next(((number, name) for form, number, name in filings if form == "10-K" and name), None)
    if annual:
        number, name = annual
        suffix = name.rpartition(".")[2] if "." in name else "htm"
        yield number, f"https://www.sec.gov/Archives/edgar/data/{int(page)}/{number.replace('-', '')}/{name}", suffix, page


def wikipedia_entries(page: str, answer: bytes) -> Iterator[Entry]:
    for m in json.loads(answer).get("query", {}).get("categorymembers", []):
        name = m["title"].replace(" ", "_")
        yield name, f"https://en.wikipedia.org/api/rest_v1/page/pdf/{quoted(name)}", "pdf", m["title"]


def archive_entries(page: str, answer: bytes) -> Iterator[Entry]:
    """The smallest PDF of an item (page is its identifier)."""
    pdfs = [f for f in json.loads(answer).get("files", []) if f.get("name", "").lower().endswith(".pdf")]
    if pdfs:
        least = sorted(pdfs, key=lambda f: (int(f.get("size") or 0), f["name"]))[0]["name"]
        yield page, f"https://archive.org/download/{page}/{quoted(least)}", "pdf", least


def datagov_entries(page: str, answer: bytes) -> Iterator[Entry]:
    """The first PDF of every package."""
    for package in json.loads(answer).get("result", {}).get("results", []):
        pdf = next((r for r in package.get("resources", []) if (r.get("format") or "").upper() == "PDF" and r.get("url")), None)
        if pdf:
            yield pdf.get("id") or package.get("id"), pdf["url"], "pdf", package.get("name") or ""


def rtd_entries(page: str, answer: bytes) -> Iterator[Entry]:
    """A project's manual; the project's address says all, so nothing is asked."""
    yield page, f"https://{page}.readthedocs.io/_/downloads/en/latest/pdf/", "pdf", page


@dataclass(frozen=True)
class Catalogue:
    request: Callable[[str, int], str | None]  # page, size -> address
    entries: Callable[[str, bytes], Iterator[Entry]]
    wait: float  # seconds between requests


CATALOGUES = {
    "arxiv": Catalogue(lambda p, n: f"http://export.arxiv.org/api/query?search_query=cat:{p}&start=0&max_results={n}&sortBy=submittedDate&sortOrder=descending", arxiv_entries, 3.0),
    "sec": Catalogue(lambda p, n: f"https://data.sec.gov/submissions/CIK{int(p):010d}.json", sec_entries, 0.15),
    "wikipedia": Catalogue(lambda p, n: f"https://en.wikipedia.org/w/api.php?action=query&list=categorymembers&cmtitle=Category:{quoted(p)}&cmlimit={n}&cmtype=page&format=json", wikipedia_entries, 0.3),
    "archive": Catalogue(lambda p, n: f"https://archive.org/metadata/{quoted(p)}", archive_entries, 1.0),
    "datagov": Catalogue(lambda p, n: f"https://catalog.data.gov/api/3/action/package_search?q=report%20OR%20form%20OR%20statistics&rows={n}&start={int(p) * n}&fq=res_format:PDF", datagov_entries, 0.5),
    "rtd": Catalogue(lambda p, n: None, rtd_entries, 0.5),
}


class Throttle:
    """At most one request in `wait` seconds to each host; waits what is missing."""

    def __init__(self, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.clock, self.sleep, self.last = clock, sleep, {}

    def before(self, url: str, wait: float) -> None:
        host = urllib.parse.urlsplit(url).netloc
        missing = self.last.get(host, -wait) + wait - self.clock()
        if missing > 0:
            self.sleep(missing)
        self.last[host] = self.clock()


def again(call: Callable[[], object], tries: int = 3, first: float = 1.0, sleep: Callable[[float], None] = time.sleep):
    """What the call gives; errors whose `status` or `code` is 429 or 5xx are tried again after 1, 2, 4 ... waits."""
    for k in range(tries):
        try:
            return call()
        except Exception as e:
            code = getattr(e, "status", None) or getattr(e, "code", None)
            if k + 1 == tries or not (code == 429 or isinstance(code, int) and 500 <= code < 600):
                raise
            sleep(first * 2**k)
    raise ValueError("no tries")


def download(stream: Callable[[str], Iterator[bytes]], url: str, target: str, wait: float = 0.0, throttle: Throttle | None = None, sleep: Callable[[float], None] = time.sleep) -> tuple[int, str]:
    """Writes what a stream of blocks gives beside the target and renames it when it is whole; bytes and SHA-256, block by block, so that the size of a file does
    not matter."""
    throttle = throttle or Throttle(sleep=sleep)

    def once() -> tuple[int, str]:
        throttle.before(url, wait)
        digest, n = hashlib.sha256(), 0
        draft = Path(f"{target}.part")
        draft.parent.mkdir(parents=True, exist_ok=True)
        with draft.open("wb") as f:
            for block in stream(url):
                f.write(block)
                digest.update(block)
                n += len(block)
        draft.rename(target)
        return n, digest.hexdigest()

    return again(once, sleep=sleep)


def saved(folder: str) -> Callable[[str], bytes]:
    """Answers from a folder, named by the SHA-256 of the address."""
    return lambda url: (Path(folder) / hashlib.sha256(url.encode()).hexdigest()).read_bytes()


def online(url: str, agent: str = "quillmark (contact: see the operator of this job)") -> bytes:
    with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": agent}), timeout=60) as r:
        return r.read()


class CatalogueSource(DataSource):
    """Options: catalogue, pages (comma-separated), size (entries a request), and either folder (saved answers) or get ("module:function" that gives bytes); the
    network without both."""

    @classmethod
    def name(cls) -> str:
        return "catalogue"

    def schema(self) -> str:
        return "source string, page string, id string, url string, format string, title string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.kind = options["catalogue"]
        self.pages = [p.strip() for p in options.get("pages", "").split(",") if p.strip()]
        self.size = int(options.get("size", 50))
        self.folder, self.get = options.get("folder"), options.get("get")
        if self.kind not in CATALOGUES:
            raise ValueError(f"no catalogue {self.kind}: {', '.join(CATALOGUES)}")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.pages]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        one, page = CATALOGUES[self.kind], partition.value
        url = one.request(page, self.size)
        if self.folder:
            get = saved(self.folder)
        elif self.get:
            module, _, name = self.get.partition(":")
            get = getattr(importlib.import_module(module), name)
        else:
            get = online
        throttle = Throttle()

        def ask() -> bytes:
            throttle.before(url, one.wait)
            return get(url)

        answer = again(ask) if url else b""
        for k, entry in enumerate(one.entries(page, answer)):
            if k == self.size:
                break
            yield (self.kind, page, *entry)


def entries(spark: SparkSession, catalogue: str, pages: list[str], size: int = 50, folder: str | None = None) -> DataFrame:
    """(source, page, id, url, format, title) of a catalogue's pages."""
    spark.dataSource.register(CatalogueSource)
    r = spark.read.format("catalogue").option("catalogue", catalogue).option("pages", ",".join(pages)).option("size", str(size))
    return (r.option("folder", folder) if folder else r).load()

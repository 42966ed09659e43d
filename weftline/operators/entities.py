"""Entities: who owns a page, and texts that name another one."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.urls import host, parse_url, path

SNIPPET = 160
MAX_EVIDENCE = 25
_WORD = re.compile(r"[^\W_]+(?:['‘’&.-][^\W_]+)*")
# Words that join others in names.
JOINING = frozenset("a an and at by de del for in of on the to with".split())


def registry(spark: SparkSession, entries: list[dict]) -> tuple[DataFrame, DataFrame]:
    """entries ({key, names, urlMatchers: [{host, pathPrefix}]}) as entities (key, ord, name) and matchers (key, ord, host, prefix); unusable ones are left out."""
    names = [(e["key"], i, n) for e in entries if e.get("key") for i, n in enumerate(e.get("names") or []) if isinstance(n, str) and _WORD.search(n)]
    matchers = []
    for e in entries:
        for m in e.get("urlMatchers") or []:
            url = parse_url("http://" + re.sub(r"^[a-z][a-z0-9+.-]*://", "", m.get("host", "").strip(), flags=re.IGNORECASE)) if m.get("host") else None
            prefix = m.get("pathPrefix", "").strip()
            if url and prefix.startswith("/") and not prefix.startswith("//"):
                matchers.append((e["key"], len(matchers), url.host.removesuffix(".").removeprefix("www."), prefix.lower().rstrip("/") + "/"))
    return spark.createDataFrame(names, "key string, ord int, name string"), spark.createDataFrame(matchers, "key string, ord int, host string, prefix string")


def owners(pages: DataFrame, matchers: DataFrame) -> DataFrame:
    """pages (page_id, url), matchers (key, ord, host, prefix) -> page_id, owner: the matcher of the host (without www.) with the longest prefix of the path, then the first; null if none."""
    keyed = pages.select("page_id", F.regexp_replace(host(F.col("url")), "^www\\.", "").alias("host"), F.concat(F.regexp_replace(F.lower(path(F.col("url"))), "/$", ""), F.lit("/")).alias("at"))
    hit = keyed.join(matchers, "host").where(F.startswith("at", "prefix"))
    best = hit.groupBy("page_id").agg(F.max_by("key", F.struct(F.length("prefix"), (-F.col("ord")).alias("o"))).alias("owner"))
    return pages.select("page_id").join(best, "page_id", "left")


def fold_word(word: str) -> str:
    plain = "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c)).lower()
    return re.sub(r"['‘’]s?$", "", plain.replace("‘", "'").replace("’", "'"))


def words_of(text: str) -> list[tuple[str, int, int]]:
    return [(fold_word(m[0]), m.start(), m.end()) for m in _WORD.finditer(text)]


@dataclass
class Names:
    """A trie of the names with two words or more that aren't joining words."""

    children: dict[str, Names] = field(default_factory=dict)
    keys: list[str] = field(default_factory=list)
    name: str = ""

    @classmethod
    def of(cls, names: list[tuple[str, str]]) -> Names:
        root = cls()
        for key, name in names:
            words = [w for w, _, _ in words_of(name)]
            if sum(w not in JOINING for w in words) < 2:
                continue
            at = root
            for w in words:
                at = at.children.setdefault(w, cls())
            at.name = at.name or " ".join(name.split())
            if key not in at.keys:
                at.keys.append(key)
        return root

    def find(self, text: str) -> Iterator[tuple[Names, int, int, list[str]]]:
        """Longest matches from the left, not overlapping."""
        words, i = words_of(text), 0
        while i < len(words):
            at, best = self, None
            for j in range(i, len(words)):
                at = at.children.get(words[j][0])
                if at is None:
                    break
                if at.keys:
                    best = at, j
            if best is None:
                i += 1
                continue
            yield best[0], words[i][1], words[best[1]][2], [w for w, _, _ in words[i : best[1] + 1]]
            i = best[1] + 1


def _within(a: list[str], b: list[str]) -> bool:
    return any(a[i : i + len(b)] == b for i in range(len(a) - len(b) + 1))


def snippet(text: str, start: int, end: int) -> str:
    if len(text) <= SNIPPET:
        return text
    room = SNIPPET - 2
    low = max(0, start - max(0, room - (end - start)) // 2)
    high = min(len(text), low + room)
    low = max(0, high - room)
    return ("…" if low else "") + text[low:high].strip() + ("…" if high < len(text) else "")


def scanned(pages: DataFrame) -> DataFrame:
    """Parsed pages (page_id, page) -> page_id, ord, field, question, text: what mentions are looked for in."""
    return pages.select("page_id", F.posexplode("page.scan").alias("ord", "s")).select("page_id", "ord", "s.*")


def evidence(found: DataFrame, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """mentions() [with ord and question] -> the first mention of an entity in each text, numbered on each page; a report lists MAX_EVIDENCE (listed) and counts all."""
    first = Window.partitionBy(*keys, "field", "question", "entity").orderBy("ord", "start")
    rows = found.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("ord", "start", "entity")))
    return rows.withColumn("listed", F.col("place") <= MAX_EVIDENCE)


def mentions(texts: DataFrame, entities: DataFrame) -> DataFrame:
    """texts (page_id, owner, field, text[, ord, question]), entities (key, name) -> page_id, owner, field, ord, question, entity, name, start, end, snippet.

    A registry is small by nature; its names travel to the tasks as a trie. A name that its owner has too, or that is part
    of one of the owner's names or holds one, isn't another's.
    """
    known = [(r.key, r.name) for r in entities.orderBy("key", "ord").collect()]
    sent = texts.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, own = Names.of(sent.value), {}
        for key, name in sent.value:
            own.setdefault(key, []).append([w for w, _, _ in words_of(name)])
        for batch in batches:
            out = []
            for page, owner, where, text, ord_, question in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                for node, start, end, words in trie.find(text or "") if owner else ():
                    if owner not in node.keys and not any(_within(n, words) or _within(words, n) for n in own.get(owner, [])):
                        out.append((page, owner, where, ord_, question, min(node.keys), node.name, start, end, snippet(text, start, end)))
            names = ["page_id", "owner", "field", "ord", "question", "entity", "name", "start", "end", "snippet"]
            kinds = [batch.column(0).type, pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 10, kinds, strict=True)], names)

    kind = texts.schema["page_id"].dataType.simpleString()
    extra = [F.col(c) if c in texts.columns else F.lit(None).alias(c) for c in ("ord", "question")]
    told = texts.select("page_id", "owner", "field", "text", extra[0].cast("int").alias("ord"), extra[1].cast("string").alias("question"))
    return told.mapInArrow(run, f"page_id {kind}, owner string, field string, ord int, question string, entity string, name string, start int, end int, snippet string")

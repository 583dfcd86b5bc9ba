"""Language identification by Bayesian evidence fusion (operator 2).

For every page, four pieces of evidence meet in one posterior over the languages of a labelled corpus: the likelihood
of its visible text, the language its markup declares, its address suffix, and its host. Suffix and host act as a prior
that is smoothed down a hierarchy (all pages, suffix, domain, host), each level by grouped sums over all pages; a page's
own evidence is taken out of the sums before they judge it.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxmill.llm.text import utf8
from boxmill.session import write_table

BUCKET_BITS = 14
# A table of a language takes 128 KB in every task, so this bounds it to 64 MB. There are fewer than 200 two-letter codes.
MAX_LANGUAGES = 500

# A text counts as at most so many independent three-byte runs; neighbouring runs say much the same.
EFFECTIVE_RUNS = 60
# Weight, in pages, of the level above in a level's prior.
SMOOTHING = 8.0
# Weight, in pages, of a country suffix for its language.
SUFFIX_PAGES = 20.0
MICRO = 1_000_000

# Country suffixes and the language most of their pages are in.
SUFFIX_LANGUAGE = {
    "at": "de",
    "au": "en",
    "ca": "en",
    "de": "de",
    "es": "es",
    "fr": "fr",
    "gb": "en",
    "ie": "en",
    "it": "it",
    "mx": "es",
    "nl": "nl",
    "pl": "pl",
    "pt": "pt",
    "uk": "en",
    "us": "en",
}

# Second-level names under which country suffixes register domains.
REGISTERED = {"ac", "co", "com", "edu", "gov", "net", "org"}

_HIDDEN = re.compile(r"<!--|<(script|style|template|noscript)\b", re.IGNORECASE)
_ENDS = {n: re.compile(rf"</{n}\s*>", re.IGNORECASE) for n in ("script", "style", "template", "noscript")}
_TAG = re.compile(r"<[^>]*>")
_ROOT = re.compile(r"<html\b", re.IGNORECASE)
_LANG = re.compile(r"\blang\s*=\s*[\"']?([A-Za-z]{1,8})", re.IGNORECASE)
_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", re.IGNORECASE)
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 97 <= b <= 122 else 32 for b in range(256))


def visible_text(page: str | None) -> str:
    """The text of a page without markup, scripts, styles and comments.

    One way through the page, however it is made: what has no end once has none later, and behind the last ``>`` is no tag.
    """
    page = page or ""
    parts, at, endless = [], 0, set()
    while start := _HIDDEN.search(page, at):
        name = (start[1] or "").lower()
        stop = -1
        if name not in endless:
            if name:
                end = _ENDS[name].search(page, start.end())
                stop = end.end() if end else -1
            else:
                end = page.find("-->", start.end())
                stop = end + 3 if end >= 0 else -1
        if stop < 0:
            endless.add(name)
            parts.append(page[at : start.end()])
            at = start.end()
        else:
            parts += [page[at : start.start()], " "]
            at = stop
    shown = "".join([*parts, page[at:]])
    last = shown.rfind(">") + 1
    return markup.unescape(_TAG.sub(" ", shown[:last]) + shown[last:])


def declared_language(page: str | None) -> str | None:
    """The primary subtag of the ``lang`` attribute of the root element."""
    page, at = page or "", 0
    while root := _ROOT.search(page, at):
        end = page.find(">", root.end())
        at = end if end >= 0 else len(page)
        if found := _LANG.search(page, root.end(), at):
            return found[1].lower()
    return None


def host_parts(url: str | None) -> tuple[str, str, str]:
    """Host, domain and suffix; empty without a host.

    The domain is the last two labels, or three where a country's suffix registers names below a second level such as ``co.uk``.
    """
    found = _HOST.match(url or "")
    host = found[1].lower().rstrip(".") if found else ""
    labels = host.split(".")
    below = len(labels) > 2 and len(labels[-1]) == 2 and labels[-2] in REGISTERED
    return host, ".".join(labels[-3 if below else -2 :]), labels[-1] if len(labels) > 1 else ""


def run_buckets(raw: bytes) -> np.ndarray:
    """Buckets of all three-byte runs of a text; all but letters counts as a blank."""
    a = np.frombuffer(b" " + b" ".join(raw.translate(_LETTERS).split()) + b" ", np.uint8).astype(np.uint32)
    if len(a) < 3:
        return np.zeros(0, np.int64)
    code = (a[:-2] << 16) | (a[1:-1] << 8) | a[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)


@dataclass
class Profiles:
    """``log_share[l, b]``: how likely a run of language ``l`` falls into bucket ``b``."""

    languages: list[str]
    log_share: np.ndarray

    def log_likelihood(self, text: str) -> tuple[int, np.ndarray]:
        """Number of runs, and the likelihoods' logarithms, tempered and relative to the best language."""
        found = run_buckets(text.encode("utf-8", "surrogatepass"))
        if not len(found) or not self.languages:
            return 0, np.zeros(len(self.languages))
        buckets, uses = np.unique(found, return_counts=True)
        total = (self.log_share[:, buckets] * uses).sum(axis=1) * min(1.0, EFFECTIVE_RUNS / len(found))
        return len(found), total - total.max()


def profiles(documents: DataFrame) -> Profiles:
    """Counts the runs of all labelled documents by language; null labels and texts are left out."""
    rows_in = documents.select(F.lower("lang").alias("lang"), "text").where("lang IS NOT NULL AND text IS NOT NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals: dict[str, np.ndarray] = {}
            waiting: dict[str, list[bytes]] = {}

            def flush(lang: str) -> None:
                found = np.bincount(run_buckets(b" ".join(waiting.pop(lang))), minlength=1 << BUCKET_BITS)
                totals[lang] = totals.get(lang, 0) + found

            for lang, raw in zip(batch.column("lang").to_pylist(), utf8(batch.column("text"))):
                waiting.setdefault(lang, []).append(raw)
                if sum(map(len, waiting[lang])) > 1 << 18:
                    flush(lang)
            for lang in list(waiting):
                flush(lang)
            for lang, found in totals.items():
                used = np.flatnonzero(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(found[used])],
                    names=["lang", "bucket", "n"],
                )

    counts = rows_in.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = write_table(counts, "language-profiles")
    languages = sorted(r["lang"] for r in counts.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    table = np.full((len(languages), 1 << BUCKET_BITS), 0.5)
    found = counts.toArrow()
    place = {lang: k for k, lang in enumerate(languages)}
    rows = np.array([place[x] for x in found.column("lang").to_pylist()], np.int64)
    np.add.at(table, (rows, found.column("bucket").to_numpy()), found.column("n").to_numpy())
    return Profiles(languages, np.log(table / table.sum(axis=1, keepdims=True)))


def evidence(pages: DataFrame, model: Profiles) -> DataFrame:
    """``page_id, host, domain, suffix, declared, runs, text_log`` per page: small rows without markup."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
                out.append((*host_parts(url), declared_language(page), *model.log_likelihood(visible_text(page))))
            columns = list(zip(*out)) if out else [()] * 6
            arrays = [batch.column("page_id"), *(pa.array(c, pa.string()) for c in columns[:4])]
            arrays += [pa.array(columns[4], pa.int64()), pa.array([list(c) for c in columns[5]], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "host", "domain", "suffix", "declared", "runs", "text_log"])

    kind = pages.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, host string, domain string, suffix string, declared string, runs long, text_log array<double>"
    return pages.select("page_id", "url", "html").mapInArrow(rows, schema)


def _softmax(logs: list[Column]) -> list[Column]:
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    weights = [F.exp(x - top) for x in logs]
    return [w / sum(weights[1:], weights[0]) for w in weights]


def identified(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """``page_id, host, declared, text_lang, lang, confidence`` per page.

    ``text_lang`` follows the text alone (null without letters), ``lang`` all evidence. Pages without text, markup or
    address fall back on what is left, at last on the share of each language among all pages. Equal posteriors go to the
    first language by name; repeated rows count as often as they occur; without labelled documents ``lang`` is null.
    Sums are whole numbers of millionths, so reruns agree. Every level's table has one row per host at most and meets the pages
    in one join on the host, which Spark may split at a hot host.
    """
    model = profiles(documents)
    langs = model.languages
    if not langs:
        nothing = F.lit(None).cast("string")
        return evidence(pages, model).select("page_id", "host", "declared", nothing.alias("text_lang"), nothing.alias("lang"), F.lit(0.0).alias("confidence"))
    each = range(len(langs))
    rows = write_table(evidence(pages, model), "language-evidence")
    told = F.when(F.col("declared").isin(langs), F.col("declared")).when(F.col("declared").isNull(), "-").otherwise("?")
    rows = rows.withColumn("told", told)

    # How often pages in a language (by their text) declare each language, another one, or none.
    by_text = _softmax([F.col("text_log")[k] for k in each])
    sums = rows.groupBy("told").agg(*(F.sum(F.round(by_text[k] * MICRO).cast("long")).alias(f"n{k}") for k in each)).collect()
    kinds = [*langs, "?", "-"]
    seen = np.full((len(kinds), len(langs)), 1.0)
    for r in sums:
        seen[kinds.index(r["told"])] += [r[f"n{k}"] / MICRO for k in each]
    log_told = np.log(seen / seen.sum(axis=0))
    place = F.array_position(F.array(*map(F.lit, kinds)), F.col("told")).cast("int")
    told_log = [F.element_at(F.array(*(F.lit(float(x)) for x in log_told[:, k])), place) for k in each]
    own_logs = [F.col("text_log")[k] + told_log[k] for k in each]
    rows = rows.withColumn("own_log", F.array(*own_logs))
    own = [F.round(p * MICRO).cast("long") for p in _softmax([F.col("own_log")[k] for k in each])]
    rows = rows.withColumn("own", F.array(*own))

    def level(table: DataFrame, column: str, keys: list[str], name: str) -> DataFrame:
        return table.groupBy(*keys).agg(F.array(*(F.sum(F.col(column)[k]) for k in each)).alias(name))

    hosts = level(rows, "own", ["suffix", "domain", "host"], "of_host")
    domains = level(hosts, "of_host", ["suffix", "domain"], "of_domain")
    suffixes = level(domains, "of_domain", ["suffix"], "of_suffix")
    world = [n or 0 for n in level(suffixes, "of_suffix", [], "of_all").first()["of_all"]]
    known = hosts.join(domains, ["suffix", "domain"]).join(suffixes, "suffix")
    joined = rows.join(known.drop("suffix", "domain"), "host").withColumn("of_all", F.array(*(F.lit(int(n)) for n in world)))

    def without_own(column: str, k: int) -> Column:
        return F.greatest(F.col(column)[k] - F.col("own")[k], F.lit(0)) / F.lit(float(MICRO))

    def total(column: str) -> Column:
        parts = [without_own(column, k) for k in each]
        return sum(parts[1:], parts[0])

    prior = [(without_own("of_all", k) + 1.0) / (total("of_all") + float(len(langs))) for k in each]
    country = F.element_at(F.create_map(*(F.lit(x) for pair in SUFFIX_LANGUAGE.items() for x in pair)), F.col("suffix"))
    spoken = [F.coalesce((country == lang).cast("double"), F.lit(0.0)) * SUFFIX_PAGES for lang in langs]
    n_spoken = F.when(country.isin(langs), F.lit(SUFFIX_PAGES)).otherwise(F.lit(0.0))
    joined = joined.withColumn("prior", F.array(*prior))
    for column, extra, n_extra in (("of_suffix", spoken, n_spoken), ("of_domain", None, None), ("of_host", None, None)):
        top = [without_own(column, k) + SMOOTHING * F.col("prior")[k] + (extra[k] if extra else F.lit(0.0)) for k in each]
        bottom = total(column) + SMOOTHING + (n_extra if extra else F.lit(0.0))
        joined = joined.withColumn("prior", F.array(*(t / bottom for t in top)))
    posterior = _softmax([F.col("own_log")[k] + F.log(F.col("prior")[k]) for k in each])
    joined = joined.withColumn("posterior", F.array(*(F.round(p, 6) for p in posterior)))
    names = F.array(*map(F.lit, langs))

    def best(values: Column) -> Column:
        return F.element_at(names, F.array_position(values, F.array_max(values)).cast("int"))

    return joined.select(
        "page_id",
        "host",
        "declared",
        F.when(F.col("runs") > 0, best(F.col("text_log"))).alias("text_lang"),
        best(F.col("posterior")).alias("lang"),
        F.array_max("posterior").alias("confidence"),
    )

"""The whole engine on storage: ingest a vault, search it, ask it, report on it.

Points, cached results and the search log are versioned tables below one folder. Every method takes
batches and returns a DataFrame; readers see whole versions only, so search goes on while a vault is
ingested again.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mneme import models, schemas
from mneme.functions import text as tx
from mneme.functions.vector import cosine
from mneme.operators import answer, cache, chunking, compress, embedding, evaluation, index, reports, retrieval
from mneme.operators.changefeed import ManifestTable
from mneme.sources import files, markdown
from mneme.storage import materialize, ship

LOG = "event_id string, at timestamp, question string, cache_hit boolean, latency_ms double"


#: Data folders of a table from which a commit is followed by a compaction.
MOST_FOLDERS = 48
#: What a generator is asked for sub-questions; its answer is salvaged as far as it can be read.
DECOMPOSE = "Zerlege die Frage in zwei oder drei eigenständige Teilfragen. Antworte nur mit einer JSON-Liste von Texten.\n\n=== FRAGE ===\n"
#: Candidates that an evaluation looks at per case.
EVALUATED = 20


class Vault:
    def __init__(
        self, spark: SparkSession, root: str, encoder: models.Encoders | models.Encoder | None = None, scorer: models.Scorer | None = None,
        generator: models.Generator = models.echo_generator, tokens: models.TokenCounter = models.CHARACTER_TOKENS,
        pdf_parser: Callable[[bytes], str] | None = None, late: models.TokenEncoder | None = None,
    ) -> None:
        ship(spark)
        self.spark, self.root = spark, root.rstrip("/")
        self.encoder, self.scorer, self.generator, self.tokens, self.pdf_parser, self.late = encoder, scorer, generator, tokens, pdf_parser, late
        self._points = ManifestTable(spark, f"{self.root}/points", "point_id")
        self._cache = ManifestTable(spark, f"{self.root}/cache", "cache_id")
        self._log = ManifestTable(spark, f"{self.root}/log", "event_id")

    def _read(self, table: ManifestTable, schema: str) -> DataFrame:
        rows = table.read()
        return rows if rows is not None else self.spark.createDataFrame([], schema)

    def _tidy(self, table: ManifestTable) -> None:
        if len(table.manifest(table.latest())["files"]) > MOST_FOLDERS:
            table.compact()

    def points(self) -> DataFrame:
        return self._read(self._points, schemas.POINT)

    # ---- writing

    def ingest(self, notes_root: str, force: bool = False) -> DataFrame:
        """Bring the index up to a folder of notes, or one note: ``source_path, status, n_chunks``, one row per note.

        Notes with the indexed hash are unchanged; those with ``indexed: false`` are taken out; those
        with an error are left as they were. New points and the removal of old ones are one commit.
        """
        return self._index(markdown.read_notes(self.spark, notes_root), force)

    def ingest_pdfs(self, path: str, domain: str, force: bool = False) -> DataFrame:
        """The same for a PDF file, or all below a folder, through the vault's parser; they carry no properties but the domain."""
        if self.pdf_parser is None:
            raise ValueError("a vault without a parser can't read PDF files")
        found = files.scan_pdfs(self.spark, path).withColumn("content_hash", tx.content_hash(F.col("content")))
        text = files.parse_pdfs(found, self.pdf_parser).withColumnRenamed("markdown", "body")
        unset = [F.lit(None).cast("string").alias(c) for c in markdown.CURATION]
        rows = found.select("path", "content_hash").join(text, "path")
        return self._index(rows.select("path", "body", F.lit(domain).alias("domain"), "content_hash", "error", *unset, tx.wikilinks(F.col("body")).alias("links"), F.lit(False).alias("skip")), force)

    def _index(self, found: DataFrame, force: bool) -> DataFrame:
        notes = materialize(found.withColumn("source_path", F.regexp_replace("path", "^file:/*", "/")).drop("path"), "notes")
        points, run = self.points(), str(uuid.uuid4())
        good = notes.where("not skip and error is null")
        changed = good if force else index.changed_files(good, points.select("source_path", "content_hash"))
        chunks = chunking.chunk_markdown(changed.select("source_path", "body"), "source_path", "body", self.tokens).withColumnRenamed("path", "source_path")
        own = changed.select("source_path", "domain", "content_hash", "links", "updated", "geprueft", "quelle")
        keyed = chunks.join(own, "source_path").withColumn("__key", tx.point_id(F.col("source_path"), F.col("chunk_id")))
        text = tx.embedding_text(F.col("document_title"), F.col("header"), F.col("text"))
        embedded = embedding.embed_chunks(keyed, "__key", "source_path", "chunk_id", text, self.encoder, self.late, self.tokens)
        new = materialize(index.build_points(embedded, F.col("source_path"), F.col("domain"), F.lit(run), F.col("content_hash")), "points")
        touched = changed.select("source_path").unionByName(notes.where("skip").select("source_path"))
        before = points.join(touched, "source_path", "left_semi")
        old = before.select("point_id").join(new.select("point_id"), "point_id", "left_anti")
        counts = new.groupBy("source_path").agg(F.count(F.lit(1)).alias("n_chunks"))
        status = F.when(F.col("skip"), "skipped").when(F.col("error").isNotNull(), "error").when(F.col("__c"), "indexed").otherwise("unchanged")
        report = notes.join(changed.select("source_path", F.lit(True).alias("__c")), "source_path", "left").join(counts, "source_path", "left")
        report = materialize(report.select("source_path", status.alias("status"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks")), "report")
        moved = before.select("domain").unionByName(new.select("domain")).distinct()
        stale = self._results_of(materialize(moved, "moved"))
        self._points.commit(new, old, run=run)
        self._tidy(self._points)
        self._forget(stale)
        return report

    def _results_of(self, domains: DataFrame) -> DataFrame | None:
        """Cached results over any of ``domains``, and those over all domains, which may hold any note; None where there are none."""
        cached = self._cache.read()
        if cached is None or not domains.take(1):
            return None
        touched = domains.where("domain is not null").unionByName(self.spark.createDataFrame([("_global",)], "domain string"))
        return cached.join(touched.distinct(), "domain", "left_semi")

    def _forget(self, entries: DataFrame | None) -> None:
        if entries is not None:
            self._cache.commit(None, entries)

    def delete(self, *source_paths: str) -> int:
        """Take notes out of the index, and the cached results that may hold them; gives the number of points removed."""
        gone = self.points().where(F.col("source_path").isin(*source_paths)).select("point_id", "domain")
        n = gone.count()
        if n:
            stale = self._results_of(materialize(gone.select("domain").distinct(), "moved"))
            self._points.commit(None, gone.select("point_id"))
            self._forget(stale)
        return n

    # ---- reading

    def _sub_queries(self, asked: DataFrame, decompose: bool) -> DataFrame:
        """``query_id, sub_idx, sub_query, domain`` and the encodings; without decomposition every question is its own only sub-query."""
        answer = models.generate(asked, F.concat(F.lit(DECOMPOSE), tx.sanitize(F.col("question"), 500)), self.generator) if decompose else asked.withColumn("answer", F.lit(None).cast("string"))
        answer = materialize(answer, "decomposed") if decompose else answer
        subs = retrieval.decompose(answer, retrieval.salvage_list(F.col("answer")))
        return models.encode_all(subs, F.col("sub_query"), self.encoder).select(*retrieval.KEYS, "sub_query", "domain", "dense", "sparse", "colbert")

    def search(self, questions: list[tuple[str, str | None]], top_k: int = 10, budget: int | None = None, use_cache: bool = True, decompose: bool = False) -> DataFrame:
        """Hits for questions (text, domain or None): ``query_id, cache_hit`` and the fields of a hit."""
        for q, _ in questions:
            schemas.check_request(q, top_k, budget=budget)
        asked = self.spark.createDataFrame([(i, q, d) for i, (q, d) in enumerate(questions)], "query_id long, question string, domain string")
        return self.search_all(asked, top_k, budget, use_cache, decompose)

    def search_all(self, asked: DataFrame, top_k: int = 10, budget: int | None = None, use_cache: bool = True, decompose: bool = False) -> DataFrame:
        """The same for any number of questions, as rows ``query_id, question, domain``.

        With ``decompose`` the generator is asked for sub-questions. Every sub-query has a list of its
        own, from the cache or by hybrid search; several lists are fused by reciprocal ranks.
        """
        began, now = time.time(), F.current_timestamp()
        queries = materialize(self._sub_queries(asked, decompose), "queries")
        numbers = queries.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_sub"))
        most = numbers.agg(F.max("n_sub")).first()[0] or 1
        kept, points = self._read(self._cache, schemas.CACHE), self.points()
        wide = kept.where(F.size("chunks") >= top_k) if use_cache else kept.limit(0)
        lookups = queries.select(F.struct(*retrieval.KEYS).alias("lookup_id"), "sub_query", "domain", "dense")
        found = materialize(cache.lookup(lookups, wide, now).select("lookup_id.*", "cache_id"), "found")
        cached = found.join(kept.select("cache_id", F.posexplode("chunks").alias("n", "point_id")), "cache_id").select(*retrieval.KEYS, "point_id", F.lit(None).cast("double").alias("score"), (F.col("n") + 1).alias("rank"))
        fresh = queries.join(found, retrieval.KEYS, "left_anti")
        made = materialize(retrieval.hybrid(fresh, points, top_k * max(most, retrieval.LEAST_DEPTH)), "made")
        lists = made.unionByName(cached).join(numbers, "query_id").where(F.col("rank") <= retrieval.depth(top_k, F.col("n_sub")))
        single = lists.where("n_sub = 1").select("query_id", "point_id", F.round("score", 6).alias("score"), "rank")
        fused = single.unionByName(retrieval.rrf(lists.where("n_sub > 1"))).where(F.col("rank") <= top_k)
        served = queries.join(found.withColumn("hit", F.lit(True)), retrieval.KEYS, "left").groupBy("query_id").agg(F.every(F.coalesce("hit", F.lit(False))).alias("cache_hit"))
        hits = materialize(fused.join(served, "query_id"), "hits")
        payload = points.select("point_id", "source", "source_path", "header", "text", "domain", "chunk_offset", "quelle", "geprueft", "updated")
        out = hits.join(payload, "point_id").withColumnRenamed("point_id", "id")
        if self.scorer is not None:
            passage = tx.passage_text(F.col("source"), F.col("header"), F.col("text"))
            rows = out.join(asked.select("query_id", "question"), "query_id")
            out = retrieval.rerank_pool(models.score(rows, F.col("question"), passage, self.scorer).drop("question"))
        if budget is not None:
            out = self._compact(out, asked, budget)
        if use_cache:
            self._remember(made, queries, kept, found, now)
        took = (time.time() - began) * 1000
        log = asked.join(served, "query_id", "left")
        self._log.append(log.select(F.expr("uuid()").alias("event_id"), now.alias("at"), "question", F.coalesce("cache_hit", F.lit(False)).alias("cache_hit"), F.lit(took).alias("latency_ms")))
        self._tidy(self._log)
        return out

    def _compact(self, hits: DataFrame, asked: DataFrame, budget: int) -> DataFrame:
        encoder = (self.encoder.dense if isinstance(self.encoder, models.Encoders) else self.encoder) or models.HashingEncoder()
        units = hits.select("query_id", "id", F.posexplode(chunking.units_of(F.col("text"))).alias("idx", "unit"))
        wanted = models.encode(asked, "question", encoder, "q").select("query_id", "q")
        encoded = models.encode(units, "unit", encoder, "u").join(wanted, "query_id")
        scored = encoded.select("query_id", "id", "idx", "unit", F.coalesce(cosine(F.col("q"), F.col("u")), F.lit(0.0)).alias("similarity"))
        counts = units.groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("n"))
        short = compress.join_units(compress.select_units(scored, ["query_id", "id"], budget), counts, ["query_id", "id"])
        return hits.join(short, ["query_id", "id"], "left").withColumn("text", F.coalesce("compact", "text")).drop("compact")

    def _remember(self, lists: DataFrame, queries: DataFrame, kept: DataFrame, found: DataFrame, now: Column) -> None:
        """One commit for the cache: the lists just made, and the entries just used with their counts raised."""
        ids = lists.groupBy(*retrieval.KEYS).agg(F.array_sort(F.collect_list(F.struct("rank", "point_id"))).alias("l")).select(*retrieval.KEYS, F.transform("l", lambda x: x["point_id"]).alias("chunks"))
        entries = cache.make_entries(queries.join(ids, retrieval.KEYS), now).dropDuplicates(["cache_id"])
        used = cache.count_hits(kept.join(found.select("cache_id").distinct(), "cache_id", "left_semi"), found)
        written = materialize(entries.unionByName(used.select(*entries.columns)).dropDuplicates(["cache_id"]), "entries")
        if written.take(1):
            self._cache.commit(written)
            self._tidy(self._cache)

    def ask(self, questions: list[tuple[str, str | None]], top_k: int = 5) -> DataFrame:
        """``query_id, answer`` for every question."""
        hits = self.search(questions, top_k)
        return self._answered(hits, self.spark.createDataFrame([(i, q) for i, (q, _) in enumerate(questions)], "query_id long, question string"))

    def _answered(self, hits: DataFrame, asked: DataFrame) -> DataFrame:
        return answer.ask(answer.prompts(answer.reorder(hits), asked), asked, self.generator)

    # ---- evaluation

    def _cases(self, cases: DataFrame, top_k: int) -> tuple[DataFrame, DataFrame]:
        """Numbered questions of the cases, and their hits with ``case_id`` and ``note``."""
        asked = cases.select(F.xxhash64("id").alias("query_id"), F.col("id").alias("case_id"), F.col("frage").alias("question"), F.lit(None).cast("string").alias("domain"))
        hits = self.search_all(asked.drop("case_id"), top_k, use_cache=False).join(asked.select("query_id", "case_id"), "query_id")
        return asked, materialize(hits.withColumn("note", tx.file_stem(F.col("source_path"))), "case-hits")

    def evaluate(self, cases: DataFrame) -> DataFrame:
        """A gold set run through the search itself: measurements per case and variant, see :func:`evaluation.summarize`."""
        _, hits = self._cases(cases, EVALUATED)
        return evaluation.score_cases(evaluation.select_variants(hits.select("case_id", "rank", "note", "text", "score")), cases)

    def judge(self, cases: DataFrame, judge: models.Judge, top_k: int = 5) -> DataFrame:
        """A gold set searched, answered and judged: three labels and ``overall_pass`` per case."""
        asked, hits = self._cases(cases, top_k)
        answers = self._answered(hits, asked.select("query_id", "question"))
        contexts = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("c")).select("query_id", F.transform("c", lambda c: c["text"]).alias("contexts"))
        rows = asked.join(answers, "query_id").join(contexts, "query_id", "left")
        return evaluation.judge_answers(rows.select("case_id", "question", F.coalesce("contexts", F.array().cast("array<string>")).alias("contexts"), "answer"), judge)

    def find_related(self, source_path: str, top_k: int = 5) -> tuple[DataFrame, DataFrame]:
        """Nearest points of other notes, and the notes joined to this one by links."""
        points = self.points()
        anchor = retrieval.anchor_vectors(points.where(F.col("source_path") == source_path)).withColumn("query_id", F.lit(0).cast("long"))
        near = retrieval.related(anchor, points, top_k).join(points.select("point_id", "source_path", "header"), "point_id")
        return near, index.neighbours_by_link(self.notes(), self.notes().where(F.col("source_path") == source_path))

    def notes(self, domain: str | None = None) -> DataFrame:
        rows = index.note_aggregates(self.points())
        return (rows.where(F.col("domain") == domain) if domain else rows).orderBy("source_path")

    def domains(self) -> DataFrame:
        return index.domain_counts(self.points()).orderBy("domain")

    def graph_check(self) -> DataFrame:
        return reports.graph_totals(self.notes())

    def open_items(self, notes_root: str, heading: str, today: Column | None = None) -> DataFrame:
        """Open items of the files themselves, indexed or not; notes marked ``indexed: false`` are left out."""
        rows = markdown.parse(markdown.scan(self.spark, notes_root)).where("not skip")
        return reports.ordered_items(reports.items_from(rows, "relative", "body", heading, "domain"), today if today is not None else F.current_date())

    def stats(self) -> DataFrame:
        """Searches, hit rate, latency figures, points, domains, cached results and their uses: one row."""
        log = self._read(self._log, LOG)
        totals = reports.runtime_totals(log, F.lit(True), F.col("cache_hit")).crossJoin(reports.latency_stats(log, ["at", "event_id"], "latency_ms"))
        totals = totals.crossJoin(cache.totals(self._read(self._cache, schemas.CACHE)).withColumnsRenamed({"entries": "cached_results", "hits": "cache_uses"}))
        return totals.crossJoin(self.points().agg(F.count(F.lit(1)).alias("points"), F.count_distinct("domain").alias("domains")))  # one row each

    def health(self) -> dict:
        """Whether the tables can be read, and their versions."""
        return {"points": self._points.latest(), "cache": self._cache.latest(), "log": self._log.latest()}

    def clean_cache(self, domain: str | None = None) -> int:
        """Take out expired entries; gives how many are left."""
        kept = self._cache.read()
        if kept is None:
            return 0
        left = cache.cleanup(kept, F.current_timestamp(), domain=domain)
        self._cache.commit(None, kept.join(left.select("cache_id"), "cache_id", "left_anti"))
        self._tidy(self._cache)
        return self._cache.read().count()

    def maintain(self, versions: int = 1) -> None:
        """Compact all tables and delete what their last ``versions`` versions don't list; not while others write."""
        for table in (self._points, self._cache, self._log):
            table.compact()
            table.vacuum(versions)

"""The engine's facade: ingest, ask, evaluate, resume. Work is kept as Parquet below one folder."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import entities, text
from .operators import bm25, extraction_log, facts, graph, scores, sections
from .plans import evaluation, patterns, peers, qa, validators
from .plans.provider import Provider
from .sources import filings, shared, tables
from .sources.store import StoredGraph
from .streaming import steps


class Engine:
    def __init__(self, spark: SparkSession, root: str, provider: Provider, codes: DataFrame | None = None, known: Callable[[DataFrame], DataFrame] = lambda codes: codes, buckets: int = 8):
        """codes: industry and code; known: of codes (code) those that a service knows."""
        self.spark, self.root, self.provider, self.codes, self.known = spark, root.rstrip("/"), provider, codes, known
        self.stored = StoredGraph(spark, f"{self.root}/graph", buckets)

    # State

    def _path(self, job: str, *names: str) -> str:
        return "/".join([self.root, job, *names])

    def create(self, file: str, fiscal_year: int, company: str = "") -> str:
        """A job over the filings below file. Without a company it is the one that the filing names."""
        job = uuid.uuid4().hex[:12]
        self._save({"job_id": job, "fiscal_year": fiscal_year, "file_path": file, "main_company": company, "sic_codes": [], "extraction_paths": [], "completed_steps": [], "created_at": datetime.now(UTC).isoformat()})
        return job

    def _save(self, state: dict) -> None:
        """A state is written beside the ones before it, so that a crash can't lose them."""
        number = max(self._states(state["job_id"]), default=0) + 1
        row = self.spark.createDataFrame([(json.dumps(state),)], "value string")
        row.write.text(self._path(state["job_id"], "state", str(number)))

    def _states(self, job: str) -> list[int]:
        """Numbers of the states that were written to their end."""
        folder = self._path(job, "state")
        return [int(n) for n in shared.listed(self.spark, folder) if n.isdigit() and "_SUCCESS" in shared.listed(self.spark, f"{folder}/{n}")]

    def state(self, job: str) -> dict:
        there = self._states(job)
        if not there:
            raise KeyError(f"unknown job {job}")
        return json.loads(self.spark.read.text(self._path(job, "state", str(max(there)))).first()["value"])

    def next_step(self, job: str) -> int | None:
        done = self.state(job)["completed_steps"]
        return next((k for k in range(1, len(steps.STEPS) + 1) if k not in done), None)

    def run(self, job: str, work: dict) -> dict:
        """Does the steps that aren't completed, in order; work: a function of the state for each step. Stops at the first
        failure, and another call goes on from there."""
        while (k := self.next_step(job)) is not None:
            self.emit(job, k, "running")
            try:
                state = self.state(job) | (work[k](self.state(job)) or {})
            except Exception as error:
                self.emit(job, k, "failed", error=str(error))
                raise
            state["completed_steps"] = sorted({*state["completed_steps"], k})
            self._save(state)
            self.emit(job, k, "done")
        return self.state(job)

    def emit(self, job: str, step: int, status: str, **more: str) -> None:
        event = {"job_id": job, "step": step, "name": steps.STEPS[step - 1], "label": steps.STEPS[step - 1].title(), "status": status, "ts": datetime.now(UTC).isoformat()} | more
        self.spark.createDataFrame([(json.dumps(event),)], "value string").write.mode("append").text(self._path(job, "events"))

    def events(self, job: str) -> DataFrame:
        return steps.folded(self.spark.read.schema(steps.EVENT).json(self._path(job, "events")))

    # Steps

    def parse(self, state: dict) -> dict:
        docs = filings.read(self.spark, state["file_path"])
        tables.write_stage(sections.parse(docs), self._path(state["job_id"], "sections"))
        return {}

    def detect_company(self, job: str) -> str:
        """The company that the first pages of the filing (the first by name, if there are several) name."""
        parsed = self.spark.read.parquet(self._path(job, "sections"))
        first = parsed.agg(F.min("doc").alias("doc"))
        pages = sections.first_pages(parsed.join(F.broadcast(first), "doc"))  # one row
        head = "Which company's annual report is this? Answer with its name only.\n\n"
        prompts = pages.select(F.lit(job).alias("job_id"), F.lit("company").alias("phase"), F.lit(0).alias("idx"), F.concat(F.lit(head), "text").alias("prompt"))
        said = self._kept(job)(self.provider.replies(prompts).select(text.without_thinking(F.col("reply")).alias("reply")), "company")
        found = said.select(sections.guarded_company(sections.company_name(F.col("reply"))).alias("name")).first()
        if not found:
            raise LookupError("the filing has no pages to name a company")
        return found["name"]

    def extract(self, state: dict, kind: str) -> DataFrame:
        """Typed entities of one kind from the pages of the sections that fit its queries, in every filing of the job, as its
        validator leaves them. The log says what became of the pages and entities."""
        relation = entities.relation(kind)
        job = state["job_id"]
        parsed = self.spark.read.parquet(self._path(job, "sections"))
        leaves = parsed.where("leaf").withColumn("place", F.struct("doc", "pos"))
        asked = self.spark.createDataFrame([(q, q.split(), k) for k, q in enumerate(relation.queries)], "query string, tokens array<string>, ord int")
        corpus = leaves.select("doc", "place", F.split(F.lower("title"), " ").alias("tokens"))
        found = bm25.found_or_fail(bm25.greedy(bm25.scores(corpus, asked, doc="place", by="doc"), asked), kind)
        pages = leaves.join(found.select(F.col("doc").alias("place")), "place").select("doc", F.col("title").alias("section_title"), F.explode("pages").alias("page"))
        pages = pages.select("doc", "section_title", F.col("page.page_number").alias("source_page"), F.col("page.content").alias("content"))
        keep = self._kept(job)
        pages = keep(pages, f"pages-{kind}")
        # The prompt says what is looked for, so that a page that several relations ask about gets a reply for each.
        head = f"List what this page says of {kind}, as a JSON array of objects with the fields {', '.join(c.split()[0] for c in relation.schema.split(', '))}.\n\n"
        prompts = pages.select(F.lit(job).alias("job_id"), F.lit(kind).alias("phase"), F.col("source_page").alias("idx"), F.concat(F.lit(head), "content").alias("prompt"), "doc", "source_page")
        replies = keep(self.provider.replies(prompts).select("doc", "source_page", "reply"), f"replies-{kind}")
        seen = extraction_log.counted(entities.flat(pages, replies, relation), relation)
        rows = keep(entities.extracted(pages, replies, relation, state["main_company"]), f"raw-{kind}")
        out = keep(validators.validated(relation, rows, self._run(state)), f"valid-{kind}")
        extraction_log.write(self.spark, self._path(job, "log"), job, kind, pages.count(), seen, rows.count(), out.count())
        return out

    def _run(self, state: dict) -> validators.Run:
        return validators.Run(self.spark, state["job_id"], state["main_company"], self.provider, self._kept(state["job_id"]), self.codes, self.known)

    def log(self, job: str) -> DataFrame:
        """job_id, relation, stage, n, at of every extraction: pages and entities, by what became of them."""
        return self.spark.read.schema(extraction_log.SCHEMA).json(self._path(job, "log"))

    def peers(self, hits: DataFrame, target: DataFrame, metrics: DataFrame, risks: DataFrame, most: int = 3) -> DataFrame:
        found = graph.without_target(facts.candidates(hits), target)
        accepted = facts.accepted_peers(metrics, risks.join(found.select("cik", "seq"), "cik"), most)
        return found.drop("seq").join(accepted, "cik")

    def _kept(self, job: str) -> Callable[[DataFrame, str], DataFrame]:
        def keep(df: DataFrame, label: str) -> DataFrame:
            path = self._path(job, "stages", label)
            tables.write_stage(df, path)
            return self.spark.read.schema(df.schema).parquet(path)

        return keep

    def pipeline(self, hits: Callable[[dict], DataFrame], texts: Callable[[dict], DataFrame], reported: Callable[[dict], DataFrame], taxonomy: DataFrame) -> dict[int, Callable[[dict], dict]]:
        """The five steps for run(). The callables give, for a state, what services hold: search hits, filings (cik,
        company, text) and company facts."""

        def target(state: dict) -> dict:
            job = state["job_id"]
            found = {} if state["main_company"] else {"main_company": self.detect_company(job)}
            state = state | found
            tables.write_stage(self.extract(state, "HAS_METRIC"), self._path(job, "metrics"))
            tables.write_stage(self.extract(state, "FACES_RISK"), self._path(job, "risks"))
            tables.write_stage(self.extract(state, "OPERATES_IN"), self._path(job, "industries"))
            return found | {"extraction_paths": [self._path(job, name) for name in ("metrics", "risks", "industries")]}

        def load(state: dict) -> dict:
            job = state["job_id"]
            name = F.lit(state["main_company"])
            own = graph.target_metrics(self.spark.read.parquet(self._path(job, "metrics"))).withColumn("company", name).withColumn("job_id", F.lit(job))
            tables.write_stage(graph.citation_ids(own, "TARGET_M", ["idx"], ["job_id"]), self._path(job, "target_metrics"))
            risks = self.spark.read.parquet(self._path(job, "risks")).withColumn("company", name).withColumn("job_id", F.lit(job))
            tables.write_stage(graph.citation_ids(risks, "TARGET_R", ["seq"], ["job_id"]), self._path(job, "target_risks"))
            self._load_industries(state)
            codes = self.stored.edges.read().where("rel = 'HAS_SIC_CODE'").join(self.stored.edges.read().where((F.col("rel") == "OPERATES_IN") & (F.col("src") == state["main_company"])).select(F.col("dst").alias("src")), "src", "left_semi")
            return {"sic_codes": sorted({r["dst"] for r in codes.select("dst").distinct().collect()})}

        def find_peers(state: dict) -> dict:
            job = state["job_id"]
            target_ = self.spark.createDataFrame([(state["main_company"],)], "name string")
            wanted = self.spark.read.parquet(self._path(job, "target_metrics")).select("metric_type", "gaap_concept")
            matched = self._kept(job)(peers.matched_facts(wanted, taxonomy, reported(state), state["fiscal_year"]), "matched")
            filed = self._kept(job)(peers.risk_texts(texts(state)), "risk_texts")
            chosen = self.peers(hits(state), target_, matched.select("cik"), filed.select("cik", "risk_count", "words"))
            tables.write_stage(chosen, self._path(job, "peers"))
            return {"sic_codes": state["sic_codes"]}

        def load_peers(state: dict) -> dict:
            job = state["job_id"]
            chosen = self.spark.read.parquet(self._path(job, "peers")).select("cik", "name")
            kept = lambda label: self.spark.read.parquet(self._path(job, "stages", label))
            category = self.spark.read.parquet(self._path(job, "target_metrics")).select("metric_type", "category")
            nodes = graph.peer_metrics(kept("matched").join(chosen.withColumnRenamed("name", "company"), "cik"), category).withColumn("job_id", F.lit(job))
            tables.write_stage(graph.citation_ids(nodes, "PEER_M", ["cik", "metric_type", "end"], ["job_id"]), self._path(job, "peer_metrics"))
            batches = peers.risk_batches(kept("risk_texts").join(chosen.select("cik"), "cik", "left_semi"))
            tables.write_stage(peers.structured_risks(batches, self.provider, job), self._path(job, "peer_risks"))
            edges = graph.competes_with(chosen, self.spark.createDataFrame([(state["main_company"],)], "name string"))
            tables.write_stage(edges, self._path(job, "edges"))
            self._load_peers(state, chosen, edges)
            return {}

        return {1: self.parse, 2: target, 3: load, 4: find_peers, 5: load_peers}

    def _edges(self, pairs: DataFrame, src_label: str, rel: str, dst_label: str) -> DataFrame:
        return pairs.select(F.lit(src_label).alias("src_label"), "src", F.lit(rel).alias("rel"), F.lit(dst_label).alias("dst_label"), "dst", F.create_map().cast("map<string,string>").alias("props"), F.lit(0).alias("seq"))

    def _load_industries(self, state: dict) -> None:
        """The target, its industries and their codes, in the stored graph."""
        found = self.spark.read.parquet(self._path(state["job_id"], "industries"))
        target = self.spark.createDataFrame([(state["main_company"], state["job_id"], 0)], "name string, job_id string, seq int")
        self.stored.add("TargetCompany", "name string, job_id string", ["name"], target, F.col("name"))
        self.stored.add("Industry", "name string, sector string", ["name"], found.select(F.col("industry").alias("name"), "sector", "seq"), F.col("name"))
        codes, edges = graph.sic_edges(found)
        self.stored.add("SICCode", "code string, industry string, sector string", ["code"], codes.select("code", "industry", "sector", F.lit(0).alias("seq")), F.col("code"))
        own = found.select(F.lit(state["main_company"]).alias("src"), F.col("industry").alias("dst")).distinct()
        self.stored.connect(self._edges(own, "TargetCompany", "OPERATES_IN", "Industry"))
        self.stored.connect(edges.withColumn("seq", F.lit(0)))

    def _load_peers(self, state: dict, chosen: DataFrame, competes: DataFrame) -> None:
        """Peers, which compete with the target and take over its industries, in the stored graph."""
        self.stored.add("PeerCompany", "name string, cik string", ["name"], chosen.select("name", "cik", F.lit(0).alias("seq")), F.col("name"))
        self.stored.connect(self._edges(competes, "PeerCompany", "COMPETES_WITH", "TargetCompany"))
        industries = self.spark.read.parquet(self._path(state["job_id"], "industries"))
        self.stored.connect(self._edges(graph.operates_in(chosen, industries), "PeerCompany", "OPERATES_IN", "Industry"))

    # Questions and scores

    def ask(self, g: patterns.Graph, question: patterns.Question) -> dict[str, DataFrame]:
        rows = qa.deduplicated(patterns.ask(g, question))
        return {"rows": rows, "context": qa.context(rows), "citations": qa.citation_map(rows)}

    def answer(self, g: patterns.Graph, question: patterns.Question, asked: str, job: str) -> dict[str, DataFrame]:
        """Rows, citations, the answer and the trace of its reasoning (one row each), all kept below the job."""
        rows = self._kept(job)(qa.deduplicated(patterns.ask(g, question)), "rows")

        def said(phase: str, head: str, context: DataFrame) -> DataFrame:
            prompt = F.concat(F.lit(f"{head}\nCompany: {question.target}\nQuestion: {asked}\n\n"), F.coalesce("context", F.lit("[]")))
            prompts = context.select(F.lit(job).alias("job_id"), F.lit(phase).alias("phase"), F.lit(0).alias("idx"), prompt.alias("prompt"))
            return self._kept(job)(self.provider.replies(prompts).select("reply"), phase)

        answer = said("answer", "Answer from these rows and cite them as [CITE:id].", qa.context(rows)).select(text.without_thinking(F.col("reply")).alias("answer"))
        trace = said("reasoning", "Lay out step by step how these rows lead to the answer.", qa.context(rows, qa.REASONING_ROWS, whole=True)).select(text.reasoning_trace(F.col("reply")).alias("reasoning"))
        clean = qa.cleaned(rows)
        extraction = clean.agg(F.count("*").alias("record_count"), F.to_json(F.collect_list(F.struct(*clean.columns))).alias("results")).select(F.lit(asked).alias("question"), "record_count", "results")
        tables.write_answer(self._path(job, "answer"), extraction, answer, trace)
        return {"rows": rows, "citations": qa.citation_map(rows), "answer": answer, "reasoning": trace}

    def free(self, g: patterns.Graph, question: str, target: str, write: Callable[[str], str], tries: int = 2) -> tuple[str, DataFrame | None, str]:
        """A query that a model writes (write gets the prompt), run read-only for one company and mended once after an error."""
        prompt = f"Write one SQL query over the views {', '.join('graph_' + n for n in sorted(g))} for {target}: {question}"
        return patterns.run_repaired(g, lambda error: write(prompt + (f"\nThe last attempt failed: {error}" if error else "")), target, tries)

    def companies(self, g: patterns.Graph) -> DataFrame:
        return patterns.companies(g)

    def ready(self, g: patterns.Graph) -> DataFrame:
        return patterns.ready(g)

    def evaluate_job(self, job: str, test: str, embed: Callable[[Column], Column] | None = None, reported: DataFrame | None = None) -> dict[str, DataFrame]:
        """A test by name, over what answer() has kept of the job's question: its result rows, which are kept as CSV with
        their summary, as a scorecard and as one score. embed: a text's vector, for answer_relevancy; reported: facts, for
        num_values and context_recall."""
        if test not in evaluation.BY_NAME:
            raise ValueError(f"unknown test {test}; there are {', '.join(evaluation.BY_NAME)}")
        if test != "overall_score" and not shared.listed(self.spark, self._path(job, "answer")):
            raise LookupError("no question has been answered in this job")
        there = shared.listed(self.spark, self._path(job, "answer"))
        said = tables.evaluation_inputs(self.spark, self._path(job, "answer")) if there else self.spark.createDataFrame([], "question string, answer string")
        rows = self.spark.read.parquet(self._path(job, "stages", "rows")) if there else None
        results = lambda name: self._path(job, "evaluations", name)
        past = {t: tables.results_csv(self.spark, results(t)) for t in evaluation.BY_NAME if shared.listed(self.spark, results(t))}
        given = evaluation.Inputs(job, rows, said, self.provider, past, embed, reported)
        detail, summary = evaluation.BY_NAME[test](given)
        as_text = lambda df: df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
        tables.write_csv(as_text(detail), as_text(summary), results(test))
        back = tables.results_csv(self.spark, results(test))
        if test in scores.TESTS:
            return self.evaluate(test, back)
        mean = back.where(F.col("component").isin(*scores.SUMMARY_MARKS)) if test == "context_recall" else facts.match_counts(back)
        return {"rows": back, "weighted": mean.select(F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("weighted"))}

    def evaluate(self, test: str, rows: DataFrame) -> dict[str, DataFrame]:
        if test not in scores.TESTS:
            raise ValueError(f"unknown test {test}; there are {', '.join(scores.TESTS)}")
        return {"rows": scores.scorecard(rows, test), "weighted": scores.weighted(rows, test)}

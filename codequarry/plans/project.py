"""Projects as a library: scan one, then look up its files, graph and pages, search it, and ask about it. Lookups return DataFrames;
one that finds nothing is empty."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.config import Config
from codequarry.operators import chunking, docmap, generation, index, prompts, render, retrieval, search
from codequarry.plans import wiki
from codequarry.session import durable
from codequarry.sources import repositories

STATUSES = ("pending", "scanning", "done", "error")


class Project:
    """A source, and once it is scanned its tables and wiki. `status` goes from pending over scanning to done, or to error with a `message`;
    `events` lists (status, what was done) in order."""

    def __init__(self, spark: SparkSession, source: str, config: Config | None = None, client: generation.Client = generation.offline):
        self.spark, self.source, self.config, self.client = spark, source, config or Config(), client
        self.id, self.status, self.message = uuid.uuid4().hex[:8], "pending", ""
        self.events: list[tuple[str, str]] = []
        self.tables: dict[str, DataFrame] = {}
        self.pages: DataFrame | None = None
        self.sidebar: DataFrame | None = None
        self._chunks: DataFrame | None = None
        self._index: search.Index | None = None

    def _note(self, what: str) -> None:
        self.events.append((self.status, what))

    def events_since(self, seen: int) -> tuple[list[tuple[str, str]], int, bool]:
        """Events after the first `seen`, how many there are now, and whether no more will come."""
        return self.events[seen:], len(self.events), self.status in ("done", "error")

    def scan(self, folder: str | None = None) -> Project:
        """Fetch if need be, analyse, plan and write documents, and lay out the wiki. Failures end in status error and are not raised."""
        self.status = "scanning"
        try:
            root = self.source
            if repositories.is_url(self.spark, root):
                parts = repositories.url_parts(self.spark, root)
                root = str(repositories.fetch(repositories.clone_url(*parts) if parts else root, Path(folder or self.config.output_dir) / ".clones" / self.id))
            self.tables = wiki.analyse(self.spark, root, self.config, self.client, self._note)
            categories, docs = wiki.document_map(self.tables, self.client, language=self.config.language)
            generated = wiki.generate_documents(self.tables, docs, self.client, concurrency=self.config.concurrency, language=self.config.language)
            pages, entries = wiki.from_map(
                self.tables, categories, docs, generated.where("status = 'success'").select("doc_id", "content"),
                language=self.config.language
            )
            self.pages, self.sidebar = durable(pages), durable(entries)
            self.status = "done"
            self._note("done")
        except Exception as e:  # noqa: BLE001  a failed scan is a state of the project
            self.status, self.message = "error", str(e)[:500]
            self._note(self.message)
        return self

    def info(self) -> DataFrame:
        """project_id, status, message, name, project_type, n_files, total_lines; the last four are null until it is scanned."""
        own = self.spark.createDataFrame([(self.id, self.status, self.message)], "project_id string, status string, message string")
        if self.status != "done":
            return own.select(
                "*",
                *(
                    F.lit(None).cast(t).alias(c) for c, t in (
                        ("name", "string"), ("project_type", "string"), ("n_files", "long"), ("total_lines", "long")
                    )
                )
            )
        counts = self.tables["files"].agg(F.count("*").alias("n_files"), F.sum("lines").alias("total_lines"))
        return own.crossJoin(self.tables["name"]).crossJoin(self.tables["project"]).crossJoin(counts)

    def file(self, path: str) -> DataFrame:
        return self.tables["files"].where(F.col("path") == path).select("path", "language", "content", "lines")

    def page(self, page_id: str) -> DataFrame:
        return self.pages.where(F.col("id") == page_id)

    def wiki(self) -> tuple[DataFrame, DataFrame]:
        """The pages without their texts, in order, and the sidebar as text."""
        return self.pages.select("id", "title", "parent_id", "ord").orderBy("ord", "id"), render.sidebar(self.sidebar)

    def graph(self, top: int = 20) -> dict[str, DataFrame]:
        """nodes, edges, rankings (the first `top`, rounded), and the diagram."""
        files, links = self.tables["files"], self.tables["imports"]
        edges = wiki.internal_edges(links).where("src <> dst").distinct()
        rankings = self.tables["ranks"].orderBy(F.col("score").desc(), "id").limit(top).select(F.col("id").alias("path"), F.round("score", 6).alias("score"))
        return {
            "nodes": files.select(F.col("path").alias("id"), "language", "lines"), "edges": edges, "rankings": rankings,
            "diagram": render.module_diagram(files, index.module_dependencies(links))
        }

    def search(self, query: str, **filters: str) -> DataFrame:
        return index.search_files(self.tables["files"], query, **filters)

    def ask(self, question: str, top: int = retrieval.TOP_K) -> DataFrame:
        """answer, status, refs: the client's answer from the chunks most like the question. Chunks and their index are made once."""
        if self._chunks is None:
            rows = chunking.line_chunks(self.tables["files"].select("path", "content"))
            name = F.concat("path", F.lit("#"), F.lpad(F.col("chunk_no").cast("string"), 6, "0"))
            self._chunks = durable(rows.withColumn("chunk_id", name))
            self._index = search.index_of(self._chunks.select("chunk_id", "content"))
        asked = self.spark.createDataFrame([("q", question)], "query_id string, content string")
        hits = self._index.search(asked, top).join(self._chunks, "chunk_id")
        context = asked.select("query_id").join(retrieval.chat_context(hits), "query_id", "left")
        prompt = prompts.chat(F.lit(question), F.col("context"), self.config.language)
        answer = generation.complete(context.select(F.col("query_id").alias("id"), prompt.alias("prompt")), self.client, concurrency=1)
        return answer.join(context, answer["id"] == context["query_id"]).select("answer", "status", "refs")


class Projects:
    """Projects of a session by id."""

    def __init__(self) -> None:
        self._known: dict[str, Project] = {}

    def add(self, project: Project) -> str:
        self._known[project.id] = project
        return project.id

    def get(self, project_id: str) -> Project | None:
        return self._known.get(project_id)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(p.id, p.source, p.status) for p in self._known.values()]
        return spark.createDataFrame(rows, "project_id string, source string, status string")


def doc_page(project: Project, docs: DataFrame, doc_id: str) -> DataFrame:
    """The page of a planned document."""
    return project.pages.join(docmap.doc(docs, doc_id).select(F.concat(F.lit("docs/"), "id").alias("id")), "id", "left_semi")

"""The engine as one object: index, search, find, exact, read, context, ls, status, train (the API of the survey's §2.14)."""

from __future__ import annotations

import time
import uuid
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseam.functions import text as tx
from lodeseam.functions import vectors as vx
from lodeseam.operators import chunking, diversity, feedback, graph, incremental, merge, ranking, search, structural
from lodeseam.operators.embedding import Embedder, embed, hashing_embedder
from lodeseam.plans import planner
from lodeseam.schemas import as_hits
from lodeseam.sources import corpus, state
from lodeseam.streaming import refresh


def _new_name(kind: str) -> str:
    return f"{kind}-{int(time.time())}-{uuid.uuid4().hex[:8]}"


class Engine:
    """An index of the source files below a root, kept as Parquet in a folder of any file system that Spark reaches.

    An index is a full build and layers on top of it: every set of changed files that was indexed since then, with the
    fresh rows of these files. The newest layer that names a file speaks for it. Layers become current by one small
    pointer document, so readers never see half an index and a failed build leaves the old one in place; a full build
    folds the layers in.
    """

    #: Layers after which the next change folds them into a full build.
    MOST_LAYERS = 16

    def __init__(self, spark: SparkSession, root: str, store: str, embedder: Embedder = hashing_embedder, ignore: list[str] = ()):
        self.spark, self.root, self.folder, self.embedder = spark, root, state.Folder(spark, store), embedder
        ignore_file = Path(root) / ".ignore"
        self.ignore = [*ignore, *(corpus.ignore_patterns(ignore_file.read_text()) if ignore_file.is_file() else [])]

    # ---- index

    def _current(self) -> dict:
        return self.folder.load("current.json", {})

    def has_index(self) -> bool:
        """X29"""
        return bool(self._current().get("version"))

    def ready(self) -> tuple[bool, str | None]:
        """Whether semantic search can run, and why not."""
        if not self.has_index():
            return False, "not_indexed"
        if self.table("chunks").limit(1).count() == 0:
            return False, "empty_index"
        return True, None

    def table(self, name: str) -> DataFrame:
        """A table of the current index: chunks or manifest."""
        current = self._current()
        if not current.get("version"):
            raise FileNotFoundError("not indexed")
        base = self.spark.read.parquet(self.folder.path(current["version"], name))
        layers = current.get("layers", [])
        if not layers:
            return base
        key = "path" if name == "manifest" else "file_path"
        rows = base.withColumn("_layer", F.lit(0))
        for at, layer in enumerate(layers, 1):
            rows = rows.unionByName(self.spark.read.parquet(self.folder.path(layer, name)).withColumn("_layer", F.lit(at)))
        named = [self.spark.read.parquet(self.folder.path(layer, "paths")).withColumn("_newest", F.lit(at)) for at, layer in enumerate(layers, 1)]
        newest = reduce(DataFrame.unionByName, named).groupBy(F.col("path").alias(key)).agg(F.max("_newest").alias("_newest"))
        return rows.join(newest, key, "left").filter("_layer >= coalesce(_newest, 0)").select(*base.columns)

    def vectors(self) -> DataFrame:
        """(chunk_id, embedding) of the current index."""
        return self.table("chunks").select("chunk_id", "embedding")

    def files(self) -> DataFrame:
        return corpus.read_files(self.spark, self.root, self.ignore)

    def _chunked(self, files: DataFrame) -> DataFrame:
        fresh = chunking.chunk_files(files, modified="mtime").withColumn("rich", tx.rich_text(self.root))
        return embed(fresh, "rich", self.embedder).drop("rich")

    def index(self, force: bool = False) -> dict[str, int]:
        """Chunk and embed what changed since the last index, keep the rest; counts of changes by kind."""
        files = self.files()
        manifest = files.select(*corpus.metadata(F.col("file_path"), F.col("content"), F.col("mtime")))
        stored = None if force or not self.has_index() else self.table("manifest")
        changes = incremental.changed_files(manifest, stored).persist()
        old = self._current()
        try:
            counts = {r["change"]: r["count"] for r in changes.groupBy("change").count().collect()}
            if not counts and old.get("version") and not old.get("layers"):
                return {}
            fresh_files = files.join(changes.filter("change <> 'deleted'").select(F.col("path").alias("file_path")), "file_path", "left_semi")
            fresh = self._chunked(fresh_files)
            rows = fresh if stored is None else incremental.apply_changes(self.table("chunks"), fresh, changes)
            version = _new_name("v")
            rows.write.mode("overwrite").parquet(self.folder.path(version, "chunks"))
            manifest.write.mode("overwrite").parquet(self.folder.path(version, "manifest"))
        finally:
            changes.unpersist()
        self.folder.save("current.json", {"version": version, "layers": [], "root": self.root, "indexed_at": time.time()})
        self._drop(old)
        return counts

    def reindex(self, paths: list[str]) -> int:
        """M4: index the given files anew, and only these; ones that are gone leave the index. The number of files read.

        The result is a layer on top of the index, whatever its size; nothing else is read or written. Repeating a call
        changes nothing. Without an index the whole tree is indexed.
        """
        current = self._current()
        if not current.get("version") or len(current.get("layers", [])) >= self.MOST_LAYERS:
            self.index()
            current = self._current()
        paths = sorted(set(paths))
        if not paths:
            return 0
        files = corpus.read_files(self.spark, self.root, self.ignore, paths)
        layer = _new_name("l")
        self._chunked(files).write.mode("overwrite").parquet(self.folder.path(layer, "chunks"))
        manifest = files.select(*corpus.metadata(F.col("file_path"), F.col("content"), F.col("mtime")))
        manifest.write.mode("overwrite").parquet(self.folder.path(layer, "manifest"))
        self.spark.createDataFrame([(p,) for p in paths], "path string").coalesce(1).write.mode("overwrite").parquet(self.folder.path(layer, "paths"))
        self.folder.save("current.json", {**current, "layers": [*current.get("layers", []), layer], "indexed_at": time.time()})
        return self.spark.read.parquet(self.folder.path(layer, "manifest")).count()

    def _drop(self, current: dict) -> None:
        for name in filter(None, [current.get("version"), *current.get("layers", [])]):
            self.folder.delete(name)

    def warm(self) -> int:
        """Keep the chunk table in memory; the number of its rows."""
        return self.table("chunks").persist().count()

    def follow(self, changes: DataFrame, checkpoint: str):
        """M4-M6: after every micro-batch of a stream of changed paths, index these paths anew, save ignored ones.

        Only the batch's paths reach the driver, never contents; the source's own limit of files a trigger bounds them.
        """
        kept = changes.filter(corpus.is_indexable(F.col("path"), self.ignore, self.root))
        return refresh.refresh_index(kept, lambda paths, _: self.reindex([r["path"] for r in paths.collect()]), checkpoint)

    def clear(self) -> None:
        """K4"""
        current = self._current()
        self.folder.delete("current.json")
        self._drop(current)

    def status(self) -> dict:
        """A5"""
        if not self.has_index():
            return {"indexed": False, "reason": "not_indexed"}
        row = incremental.index_stats(self.table("chunks")).first()
        return {"indexed": True, **row.asDict(), "indexed_at": self._current().get("indexed_at")}

    # ---- reading

    def exact(self, pattern: str, limit: int = 20, ignore_case: bool = False, fixed: bool = False) -> DataFrame:
        """S8"""
        return search.limit_per_file(search.grep(self.files(), pattern, fixed, ignore_case), limit, limit)

    def _one(self, path: str) -> DataFrame:
        full = path if path.startswith("/") else f"{self.root.rstrip('/')}/{path}"
        return self.files().filter(F.col("file_path") == full)

    def read(self, location: str) -> DataFrame:
        """S9"""
        path, first, last = search.location_range(location)
        return search.read_lines(search.lines_of(self._one(path)), first, last).orderBy("line_no")

    def context(self, location: str) -> dict | None:
        """The definition around a line, else 25 lines to each side."""
        path, _, _, = search.location_range(location)
        line = int(location.rpartition(":")[2].split("-")[0]) if ":" in location else 1
        row = self._one(path).select("content").first()
        if row is None:
            return None
        lines = row["content"].replace("\r\n", "\n").split("\n")
        first, last, kind, name = chunking.block_bounds(lines, line) or (max(1, line - 25), min(len(lines), line + 25), "file", None)
        return {"start_line": first, "end_line": last, "type": kind, "name": name, "content": "\n".join(lines[first - 1 : last])}

    def ls(self, path: str = "", show_all: bool = False, dirs_only: bool = False) -> DataFrame:
        """S16, T7"""
        full = f"{self.root.rstrip('/')}/{path}".rstrip("/")
        rows = corpus.tree(self.files().select(F.col("file_path").alias("path"))).filter(F.col("dir") == full)
        if not show_all:
            rows = rows.filter(~F.startswith("name", F.lit(".")))
        if dirs_only:
            rows = rows.filter("is_dir")
        return rows.orderBy(F.desc("is_dir"), F.lower("name"))

    # ---- searching

    def search(self, query: str, limit: int = 10, expander=None) -> DataFrame:
        """§3.3: semantic hits with raw, normalised and bounded scores; sentence-like queries run in up to three variants."""
        variants = [query]
        parts = query.split()
        natural = len(parts) > 1 and (len(parts) >= 3 or any(w in tx.CUE_WORDS for w in query.lower().split()))
        if natural and not self.spark.range(1).select(tx.is_identifier_like(F.lit(query))).first()[0]:
            variants = planner.expanded_queries(query, expander)[:3]
        chunks = self.table("chunks")
        vectors = [[float(x) for x in v] for v in self.embedder(variants)]
        asked = self.spark.createDataFrame(list(enumerate(vectors)), "variant bigint, embedding array<float>").coalesce(1)
        found = search.vector_search(asked, self.vectors(), limit, "variant", "chunk_id", "embedding", exclude_self=False)
        scored = found.select(F.lit(0).cast("bigint").alias("query_id"), F.col("query_id").cast("int").alias("variant"), "row_id", vx.distance_to_score(1 - F.col("cosine")).alias("score"))
        best = search.best_of_variants(scored).withColumn("norm", vx.min_max(F.col("score"), "query_id"))
        top = best.withColumn("bounded", vx.confidence_bounds(F.col("norm"))).orderBy(F.desc("bounded"), F.desc("score"), "row_id").limit(limit)
        # the few hits are looked up first, so repeated chunks collapse among them and not over the whole table
        rows = chunks.drop("embedding").join(F.broadcast(top.withColumnRenamed("row_id", "chunk_id")), "chunk_id").dropDuplicates(["chunk_id"])
        symbols = F.when(F.size("symbols") > 0, F.col("symbols")).otherwise(tx.python_symbols(F.col("content")))
        return as_hits(
            rows.select(
                F.lit(0).alias("query_id"), F.lit("semantic").alias("source"), "file_path", "start_line", "end_line", F.col("content").alias("preview"), symbols.alias("symbols"), "language", "last_modified",
                F.col("bounded").alias("semantic_score"), F.col("score").alias("semantic_raw_score"), F.col("norm").alias("semantic_norm_score"), F.col("bounded").alias("score"),
            )
        )

    def _grep(self, plan: planner.QueryPlan, files: DataFrame, query: str, k: int) -> DataFrame:
        most = max(50, min(500, 25 * k))
        matches = search.grep(files, plan.grep_pattern, plan.grep_fixed).orderBy("file_path", "line_no").limit(most)
        base = search.base_score(len(query.split()), plan.run_semantic, plan.grep_fixed)
        hits = chunking.matches_to_hits(matches, files)
        relevance = tx.grep_relevance(F.col("preview"), F.col("file_path"), search.pattern_terms(plan.grep_pattern), F.col("end_line") - F.col("start_line") + 1, base)
        return as_hits(hits.withColumn("source", F.lit("grep")).withColumn("symbols", tx.python_symbols(F.col("preview"))).withColumn("grep_score", relevance))

    def _empty(self) -> DataFrame:
        return as_hits(self.spark.createDataFrame([], "file_path string, start_line int, end_line int"))

    def plan(self, query: str, **options) -> planner.QueryPlan:
        return planner.plan_query(query, **options)

    def find(
        self,
        query: str,
        k: int = 10,
        languages: list[str] | None = None,
        max_per_file: int = 3,
        precise: bool = False,
        weights: ranking.RankWeights = ranking.RankWeights(),
        diverse: str = "medium",
        callers: str | None = None,
        implementations: str | None = None,
        current_file: str | None = None,
        affinity: dict[str, float] | None = None,
        ltr: dict[str, float] | None = None,
        ast_top_files: int | None = 100,
        ast_max_matches: int | None = 500,
        now: float | None = None,
        plan: planner.QueryPlan | None = None,
        **options,
    ) -> DataFrame:
        """§3.2: the planned engines, merged, scored and reranked; the k best with their rank.

        Without an index the semantic engine is left out. ``options`` are those of plan_query; a ``plan`` replaces its plan.
        Without ast_top_files and ast_max_matches the structural engine takes all files and all matches.
        """
        plan = plan or planner.plan_query(query, precise=precise, **options)
        files = self.files()
        if languages:
            files = files.filter(F.col("language").isin(languages))
        grep = self._grep(plan, files, query, k) if plan.run_grep and plan.grep_pattern else self._empty()
        semantic = self.search(plan.semantic_query, max(10, 3 * k)) if plan.run_semantic and self.has_index() else self._empty()
        if languages:
            semantic = semantic.filter(F.col("language").isin(languages))
        ast = self._empty()
        if plan.run_ast:
            scope = files
            if not plan.ast_exhaustive and ast_top_files is not None:
                scope = files.join(ranking.top_files(grep if plan.run_grep else semantic, ast_top_files), "file_path", "left_semi")
            runs = [(plan.ast_language, list(plan.ast_patterns), None)] if plan.ast_patterns else []
            runs += [(*structural.load_rule(r), r) for r in plan.ast_rules]
            for language, patterns, rule in runs:
                ast = ast.unionByName(as_hits(structural.structural_search(scope, patterns, language, rule)))
            if ast_max_matches is not None:
                ast = ast.orderBy("file_path", "start_line", "start_col").limit(ast_max_matches)
        merged = merge.merge_hits(grep, semantic, ast)
        edges = graph.graph_edges(self.table("chunks")) if self.has_index() else None
        related = None
        if edges is not None and (callers or implementations):
            kind, name = ("call", callers) if callers else ("inherits", implementations)
            related = edges.filter((F.col("edge_type") == kind) & (F.col("target") == name)).select(F.col("source_file").alias("file_path"), F.col("source").alias("symbol")).distinct()
            merged = ranking.only_related(merged, related)
        imports = [r["target"] for r in edges.filter((F.col("edge_type") == "import") & (F.col("source_file") == current_file)).select("target").distinct().collect()] if edges is not None and current_file else []
        profile = self.spark.range(1).select(tx.query_profile(F.lit(query)).alias("p")).first()["p"]
        scored = ranking.score_hits(
            merged, F.lit(query), time.time() if now is None else now, weights.adapted(profile["query_type"], profile["confidence"]), plan.ast_exhaustive,
            feedback.affinity_of(F.col("file_path"), affinity or {}), ranking.context_match(F.col("file_path"), current_file, imports), ltr=ltr,
        )
        level = diversity.LEVELS[diverse]
        # only what MMR looks at is embedded
        candidates = ranking.top_hits(ranking.dedupe_previews(scored), level.max_candidates)
        ordered = diversity.mmr_rerank(embed(candidates, "preview", self.embedder, "vector"), level, ready=True).drop("vector", "rank")
        cap = ordered.withColumn("score_kept", F.col("score")).withColumn("score", -F.col("mmr_rank").cast("double"))
        capped = ranking.cap_per_file(cap, max_per_file)
        if precise:
            capped = ranking.precise(capped)
        return ranking.top_hits(capped, k).withColumn("score", F.col("score_kept")).drop("score_kept", "mmr_rank").orderBy("rank")

    # ---- feedback

    def log(self, search_id: int, query: str, hits: list, selected: int | None, at: float) -> None:
        """K9"""
        from lodeseam.schemas import FEEDBACK, FEATURES

        fields = ("file_path", "start_line", "end_line", *FEATURES)
        row = [(search_id, query, [tuple(h[f] for f in fields) for h in hits], selected, at)]
        state.append_feedback(self.spark.createDataFrame(row, "search_id bigint, " + FEEDBACK), self.folder.path("feedback"))

    def events(self) -> DataFrame:
        from lodeseam.schemas import FEEDBACK

        return self.spark.read.schema("search_id bigint, " + FEEDBACK).option("mode", "DROPMALFORMED").json(self.folder.path("feedback"))

    def train(self, min_events: int = 5) -> dict[str, float] | None:
        """Fit and keep the ranking model; None for too little feedback."""
        weights = feedback.train_ltr(feedback.results_of(feedback.searches(self.events())), min_events)
        if weights:
            self.folder.save("ltr.json", weights)
        return weights

    def weights(self) -> dict[str, float] | None:
        return self.folder.load("ltr.json", None)

"""The search engine: one call composes filters, both stages, fusion, diversity and hydration."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions.snippet import snippet_col
from lodestack.operators import filters, lexical, ranking, vector
from lodestack.operators.lexstore import LexicalStore
from lodestack.operators.plane import Plane

QUERY_PREFIX = "Represent this sentence for searching relevant passages: "
TITLE_HITS = 10
MODES = ("hybrid", "keyword", "vector")


class EmbeddingProvider(ABC):
    """Turns texts into vectors; a model plugs in here."""

    model_id: str
    dim: int

    @abstractmethod
    def encode(self, texts: list[str]) -> list[list[int]]: ...

    def encode_query(self, text: str) -> list[int]:
        return self.encode([QUERY_PREFIX + text])[0]


@dataclass(frozen=True)
class SearchOptions:
    source: str
    k: int = ranking.DEFAULT_K
    mode: str = "hybrid"
    types: tuple[str, ...] = ()
    date_from: str | None = None
    date_to: str | None = None
    scope: str | None = None
    include_old: bool = False
    current_only: bool = True
    max_per_doc: int = ranking.PER_DOC
    sort_by: str = "relevance"
    similar_to: int | None = None
    seed_text: str | None = None
    include_snippet: bool = True

    def checked(self) -> SearchOptions:
        """Bounds and enums; a seed forces vector mode, a stored seed beats a text."""
        if not 1 <= self.k <= ranking.MAX_K:
            raise ValueError(f"k must lie in 1..{ranking.MAX_K}")
        if self.mode not in MODES or self.sort_by not in ("relevance", "recency"):
            raise ValueError("unknown mode or order")
        if not 1 <= self.max_per_doc <= ranking.PER_DOC_MAX:
            raise ValueError(f"max_per_doc must lie in 1..{ranking.PER_DOC_MAX}")
        seeded = self.similar_to is not None or self.seed_text is not None
        return replace(self, mode="vector" if seeded else self.mode, seed_text=None if self.similar_to is not None else self.seed_text)

    def spec(self) -> filters.FilterSpec:
        return filters.FilterSpec(self.source, self.types, self.date_from, self.date_to, self.scope, self.include_old, self.current_only)


class Engine:
    """Search over a corpus: documents, chunks, a chunk index, a title index and chunk vectors (as in :mod:`lodestack.schema`)."""

    def __init__(
        self,
        documents: DataFrame,
        chunks: DataFrame,
        chunk_index: tuple[DataFrame, DataFrame] | LexicalStore | None,
        title_index: tuple[DataFrame, DataFrame] | None = None,
        embeddings: DataFrame | Plane | None = None,
        provider: EmbeddingProvider | None = None,
        phrases: Callable[[str], list[list[str]]] = lexical.query_phrases,
        generation: str | None = None,
    ) -> None:
        """Index and vectors may be tables or stored structures; ``phrases`` must be the tokeniser that the index was made with.

        With a ``generation``, a name that changes with the tables, what a filter
        admits is kept for later searches.
        """
        self.generation = generation
        self.documents, self.chunks, self.index = documents, chunks, chunk_index
        self.titles, self.embeddings, self.provider, self.phrases = title_index, embeddings, provider, phrases

    @classmethod
    def build(cls, documents: DataFrame, chunks: DataFrame, embeddings: DataFrame | None = None, provider: EmbeddingProvider | None = None) -> Engine:
        text = chunks.select("source_id", F.col("chunk_id").alias("row_id"), F.lit(0).alias("col"), "text")
        columns = [documents.select("source_id", F.col("native_id").alias("row_id"), F.lit(i).alias("col"), F.col(c).alias("text")) for i, c in enumerate(("title", "headings"))]
        return cls(documents, chunks, lexical.build_index(lexical.tokenised(text, "text")), lexical.build_index(lexical.tokenised(columns[0].unionByName(columns[1]), "text")), embeddings, provider)

    def eligible(self, options: SearchOptions) -> DataFrame:
        """chunk_id, document, date, is_intro of the chunks that the filters admit."""
        docs = self.documents.where(filters.document_filter(options.spec())).select("source_id", "native_id", "date")
        intro = (F.col("ord") == 0) & (F.octet_length("text") < 100)
        return self.chunks.where(F.col("source_id") == options.source).select("source_id", "native_id", "chunk_id", intro.alias("is_intro")).join(docs, ["source_id", "native_id"]).select("chunk_id", F.col("native_id").alias("document"), "date", "is_intro")

    def keyword(self, query: str, source: str, pool: DataFrame, limit: int) -> DataFrame:
        """Statistics of the whole source; the filter applies before the cut."""
        if self.index is None:
            raise ValueError("this corpus has no index of chunks")
        if isinstance(self.index, LexicalStore):
            return self.index.search(source, self.phrases(query), limit, pool.select(F.col("chunk_id").alias("row_id"))).withColumnRenamed("row_id", "chunk_id")
        postings, rows = (df.where(F.col("source_id") == source) for df in self.index)
        scored = lexical.bm25(postings, rows, self.phrases(query)).withColumnRenamed("row_id", "chunk_id")
        return lexical.top(scored.join(pool.select("chunk_id"), "chunk_id", "left_semi"), limit, "chunk_id").select("chunk_id", "score", "rank")

    def near(self, vector_: list[int], source: str, pool: DataFrame, limit: int, spec: filters.FilterSpec | None = None) -> DataFrame:
        if self.embeddings is None:
            raise ValueError("this corpus has no vectors")
        if isinstance(self.embeddings, Plane):
            key = f"{self.generation}|{spec.key()}" if self.generation and spec else None
            return self.embeddings.nearest(source, vector_, limit, pool, key=key).select("chunk_id", "score", "rank")
        return vector.nearest(self.embeddings, vector_, limit, eligible=pool).select("chunk_id", "score", "rank")

    def _query_vector(self, query: str, options: SearchOptions) -> list[int]:
        if options.similar_to is not None and isinstance(self.embeddings, Plane):
            return self.embeddings.vector(options.source, options.similar_to)
        if options.similar_to is not None:
            found = self.embeddings.where(F.col("chunk_id") == options.similar_to).select("embedding").limit(2).collect()
            if len(found) != 1:
                raise ValueError(f"no unique vector {options.similar_to}")
            return list(found[0].embedding)
        if self.provider is None:
            raise ValueError("vector search needs an embedding provider")
        text = (options.seed_text or "").strip()
        return self.provider.encode([text])[0] if text else self.provider.encode_query(query)

    def search(self, query: str, options: SearchOptions) -> DataFrame:
        """rank, chunk_id, document, title, type, date, score, snippet and the flags that hold; at most k rows."""
        o = options.checked()
        filters.require_types(self.documents, o.source, list(o.types))
        limit = ranking.frontier(o.k)
        pool = self.eligible(o)
        lists = []
        if o.mode in ("hybrid", "vector"):
            lists.append(self.near(self._query_vector(query, o), o.source, pool, limit, o.spec()))
        if o.mode in ("hybrid", "keyword"):
            lists.append(self.keyword(query, o.source, pool, limit))
        fused = ranking.rrf(*lists) if len(lists) > 1 else lists[0].select("chunk_id", "score")
        if o.similar_to is not None:
            fused = fused.where(F.col("chunk_id") != o.similar_to)
        found = ranking.with_metadata(fused, pool)
        best = ranking.diverse(found, limit if o.sort_by == "recency" else o.k, o.max_per_doc)
        if o.sort_by == "recency":
            best = ranking.by_recency(best, o.k)
        return self.hydrated(best, query, o)

    def hydrated(self, best: DataFrame, query: str, o: SearchOptions) -> DataFrame:
        """Wide columns of the winners only."""
        winners = F.broadcast(best.select("chunk_id", "score", "rank"))
        text = snippet_col(F.col("text"), query) if o.include_snippet else F.lit(None).cast("string")
        hits = self.chunks.join(winners, "chunk_id").select("rank", "score", "chunk_id", "source_id", "native_id", "ord", "anchor", text.alias("snippet"))
        flag = lambda c: F.when(c, True)
        docs = self.documents.where(F.col("source_id") == o.source).select("source_id", "native_id", "title", "type", "date", "canonical_url", flag(F.col("withdrawn_date").isNotNull()).alias("withdrawn"), flag(F.col("superseded_by").isNotNull()).alias("superseded"))
        call = F.concat(F.lit("get_chunks("), F.col("chunk_id").cast("string"), F.lit(")"))
        return docs.join(F.broadcast(hits), ["source_id", "native_id"]).withColumn("next_call", call).orderBy("rank")

    def title_hits(self, query: str, source: str, k: int = TITLE_HITS) -> DataFrame:
        """A document whose id is the whole query comes first, then titles by BM25; each document once."""
        if self.titles is None:
            raise ValueError("this corpus has no title index")
        of = lambda df: df.where(F.col("source_id") == source)
        direct = of(self.documents).where(F.col("native_id") == query.strip()).select("native_id", F.lit(None).cast("double").alias("score"), F.lit(0).alias("part"))
        scored = lexical.bm25(of(self.titles[0]), of(self.titles[1]), self.phrases(query)).select(F.col("row_id").alias("native_id"), "score", F.lit(1).alias("part"))
        best = lexical.top(scored, k, "native_id").drop("rank")
        both = direct.unionByName(best).withColumn("copy", F.row_number().over(Window.partitionBy("native_id").orderBy("part"))).where("copy = 1")
        order = [F.col("part"), F.col("score").desc(), F.col("native_id")]
        cut = both.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
        return of(self.documents).select("native_id", "title", "type", "date").join(F.broadcast(cut.select("native_id", "score", "rank")), "native_id").withColumn("snippet", F.col("title")).orderBy("rank")

"""Inverted-file indexes over raw vectors and over product-quantized codes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .config import IVFConfig, IVFPQConfig, check_probes, validated
from .evaluate import list_sizes, searched_counts, truth_per_cell
from .kmeans import assign, center_table, training_sample
from .postings import write_postings
from .quantizer import Quantizer
from .search import Kernel, coarse_topw, code_distances, code_kernel, of_cells, probe, search, vector_kernel
from .shared import shared_path


class IVFIndex:
    """Cells of a coarse codebook, each with the vectors nearest to its center.

    ``train``, then ``populate``; ``populate`` replaces what was there, ``append`` adds. Both write the postings, so that
    vectors are assigned once and a search reads only the partitions of the cells it probes.
    Results are DataFrames ``qid, rank, vec_id, dist`` with squared distances, ties by id,
    and fewer than k rows where the probed cells hold fewer.
    """

    payload = "embedding"

    def __init__(self, config: IVFConfig):
        self.config = config
        self.coarse: np.ndarray | None = None
        self.postings: DataFrame | None = None
        self.path: str | None = None
        #: A partition of the postings holds the cells of one quotient of ``cid`` by this; there are 1,024 at most.
        self.per_part = -(-config.kc // 1024)

    def train(self, vectors: DataFrame, init: str | list[int] = "points", whole: bool = False) -> IVFIndex:
        """Centers of a sample, or of all vectors if ``whole``; start points by id are looked up in all."""
        c = self.config
        vectors = validated(vectors, c.dim)
        self.coarse = Quantizer(c.dim, 1, c.kc).fit(self._training(vectors, whole), c.iterations, init, c.seed, vectors).centers[0]
        return self

    def _training(self, vectors: DataFrame, whole: bool) -> DataFrame:
        return vectors if whole else training_sample(vectors, self.config.sample_rows, self.config.seed)

    def populate(self, vectors: DataFrame, path: str | None = None) -> IVFIndex:
        """Write the postings of the vectors to ``path``, or to a path of their own in the shared folder."""
        spark = vectors.sparkSession
        self.path = path or shared_path(spark, "postings")
        return self.attach(write_postings(self._posted(vectors), self.path, self.per_part, "overwrite"))

    def append(self, vectors: DataFrame) -> IVFIndex:
        self._populated()
        if self.path is None:
            raise RuntimeError("postings that this index didn't write can't be added to")
        return self.attach(write_postings(self._posted(vectors), self.path, self.per_part, "append"))

    def attach(self, postings: DataFrame) -> IVFIndex:
        """Search these postings: ``cid, vec_id`` and the payload, in partitions ``part``."""
        self.postings = postings
        return self

    def _posted(self, vectors: DataFrame) -> DataFrame:
        return assign(validated(vectors, self.config.dim), self._trained(), ("embedding",))

    def topw(self, queries: DataFrame, w: int, clamp: bool = True) -> DataFrame:
        """``qid, rank, cid, q``: the w nearest cells; more than there are is an error unless clamped."""
        w = check_probes(w, self.config.kc, clamp)
        return coarse_topw(validated(queries, self.config.dim, "q"), self._trained(), w)

    def search(self, queries: DataFrame, k: int, w: int) -> DataFrame:
        w = check_probes(w, self.config.kc, True)
        queries = validated(queries, self.config.dim, "q")
        return search(self._populated(), queries, self._trained(), w, self.payload, k, self._kernel(), self.per_part)

    def search_cells(self, topw: DataFrame, k: int) -> DataFrame:
        """Search given cells ``(qid, cid, q)``; a cell asked for twice is scanned once."""
        return probe(self._populated(), topw, self.payload, self.config.dim, k, self._kernel(), self.per_part)

    def _kernel(self) -> Kernel:
        return vector_kernel(self.config.dim)

    def sizes(self) -> DataFrame:
        return list_sizes(self._populated(), self.config.kc)

    def searched_counts(self, topw: DataFrame) -> DataFrame:
        return searched_counts(topw, self.sizes())

    def book(self, cells: list[int]) -> DataFrame:
        """Postings of the given cells; on a stored index only their partitions are read."""
        if bad := [c for c in cells if not 0 <= c < self.config.kc]:
            raise ValueError(f"no such cells: {bad}")
        return of_cells(self._populated(), sorted(set(cells)), self.per_part).drop("part")

    def observe(self, truth: DataFrame) -> DataFrame:
        """How many of each query's true neighbours every cell holds."""
        return truth_per_cell(truth, self._populated(), self.config.kc)

    def codebook(self, spark) -> DataFrame:
        return center_table(spark, self._trained())

    def _trained(self) -> np.ndarray:
        if self.coarse is None:
            raise RuntimeError("the index isn't trained")
        return self.coarse

    def _populated(self) -> DataFrame:
        if self.postings is None:
            raise RuntimeError("the index isn't populated")
        return self.postings


class IVFPQIndex(IVFIndex):
    """The same with product codes of the raw vectors; distances are asymmetric."""

    payload = "code"
    config: IVFPQConfig

    def __init__(self, config: IVFPQConfig):
        super().__init__(config)
        self.pq = Quantizer(config.dim, config.mp, config.kp)

    def train(self, vectors: DataFrame, init: str | list[int] = "points", pq_init: str | list[int] | None = None, whole: bool = False) -> IVFPQIndex:
        super().train(vectors, init, whole)
        c = self.config
        vectors = validated(vectors, c.dim)
        self.pq.fit(self._training(vectors, whole), c.pq_iterations, init if pq_init is None else pq_init, c.seed, vectors)
        return self

    def _posted(self, vectors: DataFrame) -> DataFrame:
        posted = assign(validated(vectors, self.config.dim), self._trained(), ("embedding",))
        return self.pq.encode(posted, ("cid",)).select("vec_id", "cid", "code")

    def _kernel(self) -> Kernel:
        return code_kernel(self._populated(), self.pq._trained())

    def search_all(self, queries: DataFrame, k: int) -> DataFrame:
        """Asymmetric distances to everything."""
        return self.search(queries, k, self.config.kc)

    def distances(self, queries: DataFrame) -> DataFrame:
        """``qid, vec_id, dist``: asymmetric distances of everything to every query, unranked."""
        return code_distances(self._populated(), queries, self.pq._trained())

"""Indicator clustering of tables of numeric vectors, as Spark jobs."""

import sys

from pyspark import cloudpickle

from orthant.functions.rows import (
    indicator,
    nonnegative,
    one_hot,
    rotate,
    shrink_row,
    unit_row,
)
from orthant.functions.scores import accuracy, cluster_scores, contingency, purity
from orthant.operators.graph import degrees, fix_signs, laplacian, multiply_vectors, symmetrize
from orthant.operators.knn import knn_graph, knn_neighbors
from orthant.operators.matching import best_mapping, label_changes, relabel
from orthant.operators.selection import curvature_threshold, kth_largest
from orthant.plans.agglomerate import agglomerate
from orthant.plans.alternating import IndicatorClustering
from orthant.plans.compare import compare, kmeans_baseline
from orthant.plans.joint import JointIndicatorClustering, spectral_embedding
from orthant.plans.lloyd import lloyd
from orthant.plans.model import ClusterModel
from orthant.plans.riemann import RiemannianIndicatorClustering
from orthant.plans.robust import RobustIndicatorClustering
from orthant.session import local_session
from orthant.sources.vectors import VectorTable, load_labelled, read_table, vector_profile

# Ship kernels with the task, so that executors do not need this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = [
    "ClusterModel",
    "IndicatorClustering",
    "JointIndicatorClustering",
    "RiemannianIndicatorClustering",
    "RobustIndicatorClustering",
    "VectorTable",
    "accuracy",
    "agglomerate",
    "best_mapping",
    "cluster_scores",
    "compare",
    "contingency",
    "curvature_threshold",
    "degrees",
    "fix_signs",
    "indicator",
    "kmeans_baseline",
    "knn_graph",
    "knn_neighbors",
    "kth_largest",
    "label_changes",
    "laplacian",
    "lloyd",
    "load_labelled",
    "local_session",
    "multiply_vectors",
    "nonnegative",
    "one_hot",
    "purity",
    "read_table",
    "relabel",
    "rotate",
    "shrink_row",
    "spectral_embedding",
    "symmetrize",
    "unit_row",
    "vector_profile",
]

"""Spark-first analytics over wide, labelled feature tables."""

from cohortica.functions.colors import get_colors
from cohortica.operators.cohorts import split_by_label
from cohortica.operators.information import conditional_information, interaction, interaction_ccc, interaction_ccd, joint_information, joint_information_cc, mutual_information, pair_information
from cohortica.operators.matrix import features_by_prefix
from cohortica.operators.models import train_and_evaluate
from cohortica.operators.stats import correlations, heatmap, leaf_order, top_difference

__all__ = [
    "conditional_information",
    "correlations",
    "features_by_prefix",
    "get_colors",
    "heatmap",
    "interaction",
    "interaction_ccc",
    "interaction_ccd",
    "joint_information",
    "joint_information_cc",
    "leaf_order",
    "mutual_information",
    "pair_information",
    "split_by_label",
    "top_difference",
    "train_and_evaluate",
]

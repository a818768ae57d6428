"""ledgerlens: Spark DataFrame operators for transaction-fraud feature engineering.

Every operator is a function ``DataFrame -> DataFrame`` that builds a lazy plan;
actions happen only where a loop must test convergence or a model is fit.
"""

from ledgerlens.session import get_session, checkpoint_dir, cut_lineage, stage_path

__all__ = ["get_session", "checkpoint_dir", "cut_lineage", "stage_path"]

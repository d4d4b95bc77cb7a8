"""Evidence-graph analytics as Spark DataFrame operators."""

from corrobora.model import EvidenceGraph

__all__ = ["EvidenceGraph"]

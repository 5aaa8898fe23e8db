"""The demo case and other small pipelines as graphs."""

from __future__ import annotations

from pyspark.sql import SparkSession

from plumbline.operators.lineage import EDGES, EVIDENCE, INSPECTIONS, NODES, Graph

# fixed values: the demo case
DEMO_NODES = (
    ("C_A", "CONTRIBUTOR", "Contributor A"), ("C_B", "CONTRIBUTOR", "Contributor B"), ("DS01", "DATASET", "Dataset DS01"), ("B03", "BATCH", "Batch B03"), ("B17", "BATCH", "Batch B17"),
    ("S001", "SAMPLE", "Sample S001"), ("S184", "SAMPLE", "Sample S184"), ("S185", "SAMPLE", "Sample S185"), ("TR42", "TRAINING_RUN", "Training Run 42"), ("V4", "MODEL", "Model V4"),
    ("D7", "DEPLOYMENT", "Deployment D7"), ("IN982", "INPUT", "Input 982"), ("I982", "INFERENCE", "Inference I982"), ("O982", "OUTPUT", "Output O982"),
)
DEMO_EDGES = (
    ("C_A", "B03", "CONTRIBUTED"), ("C_B", "B17", "CONTRIBUTED"), ("DS01", "B03", "CONTAINS"), ("DS01", "B17", "CONTAINS"), ("B03", "S001", "CONTAINS"), ("B17", "S184", "CONTAINS"), ("B17", "S185", "CONTAINS"),
    ("B03", "TR42", "TRAINED_ON"), ("B17", "TR42", "TRAINED_ON"), ("TR42", "V4", "PRODUCED"), ("V4", "D7", "DEPLOYED_AS"), ("D7", "I982", "INFERRED_ON"), ("IN982", "I982", "INFERRED_ON"), ("I982", "O982", "GENERATED"),
)
DEMO_EVIDENCE = (
    ("E001", "B17", "NEAR_DUPLICATE_CLUSTER", 0.81, 0.94, "duplicate_detector"), ("E002", "B17", "LABEL_DISTRIBUTION_ANOMALY", 0.74, 0.88, "label_detector"), ("E003", "S184", "OOD_ANOMALY", 0.67, 0.83, "ood_detector"),
    ("E010", "V4", "BEHAVIORAL_DEVIATION", 0.85, 0.89, "behavior_detector"), ("E011", "V4", "TRIGGER_SENSITIVITY", 0.95, 0.94, "trigger_detector"), ("E021", "O982", "PROVENANCE_MISMATCH", 0.60, 0.90, "passport_verifier"),
)
DEMO_INSPECTIONS = (("B03", "duplicate_detector"), ("B03", "label_detector"), ("D7", "passport_verifier"))


def graph(spark: SparkSession, nodes, edges, evidence=(), inspections=(), case_id: str = "demo", depth: int | None = None) -> Graph:
    make = lambda rows, schema: spark.createDataFrame([(case_id, *r) for r in rows], schema)
    return Graph(make(nodes, NODES), make(edges, EDGES), make(evidence, EVIDENCE), make(inspections, INSPECTIONS), depth)


def demo(spark: SparkSession, extra_evidence=(), extra_edges=()) -> Graph:
    return graph(spark, DEMO_NODES, (*DEMO_EDGES, *extra_edges), (*DEMO_EVIDENCE, *extra_evidence), DEMO_INSPECTIONS, depth=7)


# a single chain from contributor to output
CHAIN_NODES = (("C", "CONTRIBUTOR", "C"), ("DS", "DATASET", "DS"), ("B1", "BATCH", "B1"), ("S1", "SAMPLE", "S1"), ("TR", "TRAINING_RUN", "TR"), ("M", "MODEL", "M"), ("D", "DEPLOYMENT", "D"), ("I", "INFERENCE", "I"), ("O", "OUTPUT", "O"))
CHAIN_EDGES = (
    ("C", "B1", "CONTRIBUTED"), ("DS", "B1", "CONTAINS"), ("B1", "S1", "CONTAINS"), ("B1", "TR", "TRAINED_ON"), ("TR", "M", "PRODUCED"), ("M", "D", "DEPLOYED_AS"), ("D", "I", "INFERRED_ON"), ("I", "O", "GENERATED"),
)
ALL_DETECTORS = ("duplicate_detector", "label_detector", "ood_detector", "behavior_detector", "trigger_detector", "hash_verifier", "passport_verifier", "structural_detector")


def inspected_everywhere(nodes=("DS", "B1", "TR", "M", "D", "I")):
    return tuple((n, d) for n in nodes for d in ALL_DETECTORS)


def chain(spark: SparkSession, evidence=(), inspections=(), case_id: str = "chain", nodes=CHAIN_NODES, edges=CHAIN_EDGES) -> Graph:
    return graph(spark, nodes, edges, [(f"E{k:03d}", *e) for k, e in enumerate(evidence, 1)], inspections, case_id, depth=7)

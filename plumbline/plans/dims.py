"""Vocabulary, thresholds and the small dimension tables of the fusion."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

# fixed values: node types by stage, stages in lifecycle order
STAGES = ("data", "training", "model", "deployment", "inference")
STAGE_OF = {
    "CONTRIBUTOR": "data", "DATASET": "data", "BATCH": "data", "SAMPLE": "data", "TRAINING_RUN": "training", "MODEL": "model",
    "DEPLOYMENT": "deployment", "CONFIGURATION": "deployment", "INPUT": "inference", "INFERENCE": "inference", "OUTPUT": "inference",
}

# fixed values: legal (source type, target type) of each edge type; MODIFIED joins any type to itself
LEGAL = {
    "CONTRIBUTED": (("CONTRIBUTOR", "DATASET"), ("CONTRIBUTOR", "BATCH"), ("CONTRIBUTOR", "SAMPLE")),
    "CONTAINS": (("DATASET", "BATCH"), ("DATASET", "SAMPLE"), ("BATCH", "SAMPLE")),
    "TRAINED_ON": (("DATASET", "TRAINING_RUN"), ("BATCH", "TRAINING_RUN")),
    "PRODUCED": (("TRAINING_RUN", "MODEL"),),
    "DERIVED_FROM": (("MODEL", "MODEL"), ("DATASET", "DATASET"), ("BATCH", "BATCH"), ("SAMPLE", "SAMPLE")),
    "DEPLOYED_AS": (("MODEL", "DEPLOYMENT"),),
    "CONFIGURES": (("CONFIGURATION", "TRAINING_RUN"), ("CONFIGURATION", "DEPLOYMENT"), ("CONFIGURATION", "INFERENCE")),
    "INFERRED_ON": (("DEPLOYMENT", "INFERENCE"), ("INPUT", "INFERENCE")),
    "GENERATED": (("INFERENCE", "OUTPUT"),),
    "REPLAYED": (("INFERENCE", "INFERENCE"),),
    "MODIFIED": tuple((t, t) for t in STAGE_OF),
}
REQUIRED_UPSTREAM = {"BATCH": ("CONTRIBUTOR",), "TRAINING_RUN": ("BATCH", "DATASET"), "MODEL": ("TRAINING_RUN",), "DEPLOYMENT": ("MODEL",), "INFERENCE": ("DEPLOYMENT",)}

# fixed values: hypotheses in tie order, with the noun phrases of reports
CLEAN, POISONING, SUBSTITUTION, BACKDOOR, TAMPERING, SHIFT = HYPOTHESES = (
    "CLEAN", "DATASET_POISONING", "MODEL_SUBSTITUTION", "BACKDOOR", "INFERENCE_TAMPERING", "BENIGN_DISTRIBUTION_SHIFT",
)
ATTACKS = (POISONING, SUBSTITUTION, BACKDOOR, TAMPERING)
PHRASES = {CLEAN: "a clean pipeline", POISONING: "dataset poisoning", SUBSTITUTION: "model substitution", BACKDOOR: "a backdoor", TAMPERING: "inference tampering", SHIFT: "a benign distribution shift"}
ORIGIN_TYPES = {POISONING: ("CONTRIBUTOR", "DATASET", "BATCH", "SAMPLE"), SUBSTITUTION: ("MODEL",), TAMPERING: ("DEPLOYMENT", "CONFIGURATION", "INPUT", "INFERENCE", "OUTPUT"), BACKDOOR: None}

# fixed values: coefficient of an evidence type for each hypothesis
COEFFICIENTS = {
    "NEAR_DUPLICATE_CLUSTER": {POISONING: 0.8, BACKDOOR: 0.3, SHIFT: -0.3, CLEAN: -1.0},
    "LABEL_DISTRIBUTION_ANOMALY": {POISONING: 1.0, BACKDOOR: 0.4, SHIFT: -0.3, CLEAN: -1.0},
    "CONTRIBUTOR_ANOMALY": {POISONING: 0.8, BACKDOOR: 0.3, SHIFT: -0.3, CLEAN: -0.9},
    "OOD_ANOMALY": {POISONING: 0.25, TAMPERING: 0.1, SHIFT: 0.8, CLEAN: -0.6},
    "TEMPORAL_ANOMALY": {POISONING: 0.4, SHIFT: 0.2, CLEAN: -0.5},
    "CLASS_IMBALANCE": {POISONING: 0.3, SHIFT: 0.2, CLEAN: -0.4},
    "BEHAVIORAL_DEVIATION": {POISONING: 0.4, BACKDOOR: 0.7, SUBSTITUTION: 0.4, SHIFT: 0.3, CLEAN: -0.8},
    "BEHAVIORAL_FINGERPRINT_DEVIATION": {POISONING: 0.4, BACKDOOR: 0.7, SUBSTITUTION: 0.4, SHIFT: 0.3, CLEAN: -0.8},
    "TRIGGER_SENSITIVITY": {POISONING: 0.5, BACKDOOR: 1.0, SHIFT: -0.9, CLEAN: -1.0},
    "STRUCTURAL_DEVIATION": {BACKDOOR: 0.1, SUBSTITUTION: 0.9, SHIFT: -0.3, CLEAN: -0.8},
    "STRUCTURAL_FINGERPRINT_DEVIATION": {BACKDOOR: 0.1, SUBSTITUTION: 0.9, SHIFT: -0.3, CLEAN: -0.8},
    "MODEL_ARTIFACT_MISMATCH": {BACKDOOR: 0.2, SUBSTITUTION: 1.0, SHIFT: -0.5, CLEAN: -1.0},
    "PROVENANCE_MISMATCH": {SUBSTITUTION: 0.3, TAMPERING: 0.9, SHIFT: -0.6, CLEAN: -1.0},
    "OUTPUT_HASH_MISMATCH": {TAMPERING: 1.0, SHIFT: -0.6, CLEAN: -1.0},
    "REPLAY_DETECTED": {TAMPERING: 1.0, SHIFT: -0.6, CLEAN: -1.0},
    "REPLAY_SUSPECTED": {TAMPERING: 1.0, SHIFT: -0.6, CLEAN: -1.0},
    "INPUT_HASH_MISMATCH": {TAMPERING: 1.0, CLEAN: -1.0},
    "SIGNATURE_INVALID": {TAMPERING: 1.0, CLEAN: -1.0},
    "SEQUENCE_GAP": {TAMPERING: 0.8, CLEAN: -0.8},
    "CHAIN_BREAK": {TAMPERING: 0.9, CLEAN: -0.9},
    "TIMESTAMP_SKEW": {TAMPERING: 0.6, CLEAN: -0.5},
    "CONFIG_MISMATCH": {SUBSTITUTION: 0.2, TAMPERING: 0.8, CLEAN: -0.8},
    "MODEL_HASH_VERIFIED": {SUBSTITUTION: -1.0},
    "DATA_PROVENANCE_VERIFIED": {POISONING: -0.6},
    "TRIGGER_PROBE_CLEAN": {BACKDOOR: -0.8},
    "PASSPORT_VERIFIED": {TAMPERING: -1.0},
    "ENVIRONMENT_METADATA_CHANGE": {SHIFT: 1.0, CLEAN: -0.2},
    "BENIGN_ENVIRONMENT_SHIFT": {SHIFT: 0.8},
}
# fixed values: prior precision of a detector
RELIABILITY = {
    "duplicate_detector": 0.91, "phash_duplicate_detector": 0.91, "label_detector": 0.86, "label_distribution_detector": 0.86, "ood_detector": 0.72,
    "behavior_detector": 0.89, "behavioral_fingerprint_detector": 0.89, "trigger_detector": 0.94, "hash_verifier": 0.99, "model_artifact_hash_checker": 0.99,
    "passport_verifier": 0.97, "structural_detector": 0.85, "structural_fingerprint_detector": 0.85, "metadata_monitor": 0.70,
}
# fixed values: what fails an integrity check, and which detectors must have run to pass it
CHECKS = {
    "dataset_integrity": (("NEAR_DUPLICATE_CLUSTER", "LABEL_DISTRIBUTION_ANOMALY", "CONTRIBUTOR_ANOMALY", "TEMPORAL_ANOMALY", "CLASS_IMBALANCE"), ("duplicate_detector", "label_detector")),
    "model_integrity": (("MODEL_ARTIFACT_MISMATCH", "STRUCTURAL_DEVIATION"), ("hash_verifier",)),
    "trigger_sensitivity": (("TRIGGER_SENSITIVITY",), ("trigger_detector",)),
    "provenance": (
        ("PROVENANCE_MISMATCH", "OUTPUT_HASH_MISMATCH", "INPUT_HASH_MISMATCH", "REPLAY_DETECTED", "REPLAY_SUSPECTED", "SIGNATURE_INVALID", "SEQUENCE_GAP", "CHAIN_BREAK", "TIMESTAMP_SKEW", "CONFIG_MISMATCH"),
        ("passport_verifier",),
    ),
}
SHIFT_SIGNALS = ("OOD_ANOMALY", "ENVIRONMENT_METADATA_CHANGE")
COVERED = ("DATASET", "BATCH", "TRAINING_RUN", "MODEL", "DEPLOYMENT", "INFERENCE")


@dataclass(frozen=True)
class FusionConfig:
    """Numbers of the fusion; every field may be replaced."""

    coefficients: dict = field(default_factory=lambda: COEFFICIENTS)
    reliability: dict = field(default_factory=lambda: RELIABILITY)
    default_reliability: float = 0.5
    gain: float = 0.5
    same_stage: float = 0.6
    corroboration_cap: float = 1.0
    clean_prior: float = 2.0
    clean_contradiction: float = 2.0
    gap_penalty: float = 0.25
    saturation: float = 1.5
    fail_weight: float = 0.15
    high: float = 0.6
    medium: float = 0.3
    direct_decay: float = 0.85
    common_discount: float = 0.5

    def __post_init__(self) -> None:
        if not all(0.0 <= r <= 1.0 for r in [*self.reliability.values(), self.default_reliability]):
            raise ValueError("reliabilities lie in [0, 1]")
        if self.saturation <= 0 or not self.medium <= self.high:
            raise ValueError("saturation must be positive and medium not above high")
        for kind, row in self.coefficients.items():
            if set(row) - set(HYPOTHESES) or not all(-1.0 <= c <= 1.0 for c in row.values()):
                raise ValueError(f"bad coefficients for {kind}")

    def with_reliability(self, **changes: float) -> FusionConfig:
        return replace(self, reliability=self.reliability | changes)

    def with_mapping(self, kind: str, row: dict) -> FusionConfig:
        return replace(self, coefficients=self.coefficients | {kind: row})


def coefficients(spark: SparkSession, config: FusionConfig) -> DataFrame:
    rows = [(t, h, float(c)) for t, row in config.coefficients.items() for h, c in row.items()]
    return spark.createDataFrame(rows, "evidence_type string, hypothesis string, coef double")


def reliabilities(spark: SparkSession, config: FusionConfig) -> DataFrame:
    return spark.createDataFrame([(d, float(r)) for d, r in config.reliability.items()], "detector string, reliability double")


def hypotheses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(h, k, h in ATTACKS) for k, h in enumerate(HYPOTHESES)], "hypothesis string, ord int, is_attack boolean")


def checks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(name, list(types), list(needed)) for name, (types, needed) in CHECKS.items()], "check string, failing array<string>, needed array<string>")


def legal_edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(e, a, b) for e, pairs in LEGAL.items() for a, b in pairs], "edge_type string, src_type string, dst_type string")


def required_upstream(spark: SparkSession) -> DataFrame:
    rows = [(t, list(need), f"{t}_WITHOUT_{'_OR_'.join(need)}") for t, need in REQUIRED_UPSTREAM.items()]
    return spark.createDataFrame(rows, "node_type string, needed array<string>, issue string")

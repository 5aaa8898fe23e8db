"""The passport verifier as a stateful stream: one state for each deployment, exactly the sequential rules.

State: the chain (last sequence and hash, re-anchoring, greatest arrival, totals) as one value, and the nonces as a map by nonce, of which a
row touches one entry. It lives in a RocksDB state store, so it may outgrow memory; set

    spark.sql.streaming.stateStore.providerClass =
        org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider

Order: rows of a micro-batch are judged by arrival, micro-batches in the order in which the source delivers them. A row whose arrival is
below one that has been judged in its deployment is late. It is judged all the same, against the state as it is then, as a verifier that
receives receipts one by one does, and marked late: a late receipt of an intact chain breaks the chain where it comes, not where it
belongs. Batch verification of the stored rows (passports.replay_state) judges by arrival alone and settles such cases.
"""

from __future__ import annotations

import hmac
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from plumbline.operators.passports import FIELDS, GENESIS, record_hash, sign

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "deployment_id string, inference_id string, arrival long, late boolean, kind string, severity double, confidence double"
CHAIN = "last_seq long, last_hash string, reanchor boolean, last_arrival long, n_ok long, n_total long"
START = (0, GENESIS, False, -1, 0, 0)


class Verifier(StatefulProcessor):
    def __init__(self, key: bytes, forget_ms: int | None):
        self.key, self.forget_ms = key, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.chain = handle.getValueState("chain", CHAIN)
        self.nonces = handle.getMapState("nonces", "nonce string", "arrival long", self.forget_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last_seq, last_hash, reanchor, last_arrival, n_ok, n_total = tuple(self.chain.get()) if self.chain.exists() else START
        out = []
        pdf = pd.concat(list(rows)).sort_values("arrival", kind="stable")
        for r in pdf[[*FIELDS, "signature", "arrival"]].to_dict("records"):
            r["timestamp"], r["sequence"], arrival = float(r["timestamp"]), int(r["sequence"]), int(r["arrival"])
            late, last_arrival, n_total = arrival < last_arrival, max(arrival, last_arrival), n_total + 1
            found = []
            if not hmac.compare_digest(sign(self.key, r), r["signature"] or ""):
                found, reanchor = [("SIGNATURE_INVALID", 1.0, 1.0)], True
            elif self.nonces.containsKey((r["nonce"],)):
                found = [("REPLAY_DETECTED", 1.0, 1.0)]
            else:
                self.nonces.updateValue((r["nonce"],), (arrival,))
                if r["sequence"] > last_seq + 1 + int(reanchor):
                    found.append(("SEQUENCE_GAP", min(1.0, 0.4 + 0.2 * (r["sequence"] - last_seq - 1)), 0.9))
                if r["prev_hash"] != last_hash and not reanchor:
                    found.append(("CHAIN_BREAK", 0.9, 0.9))
                if r["sequence"] > last_seq:
                    last_seq, last_hash = r["sequence"], record_hash(r)
                reanchor = False
            n_ok += not found
            out += [(key[0], r["inference_id"], arrival, late, *f) for f in found or [("OK", 0.0, 1.0)]]
        self.chain.update((last_seq, last_hash, reanchor, last_arrival, n_ok, n_total))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def verify_stream(records: DataFrame, key: bytes, forget_ms: int | None = None) -> DataFrame:
    """records: the columns of a passport and arrival (a stream) -> a row for each finding, kind OK where there is none.

    forget_ms bounds the state: a nonce is forgotten so many milliseconds of processing time after its receipt (None: never, as replays may
    come at any time).
    """
    mode = "None" if forget_ms is None else "ProcessingTime"
    return records.groupBy("deployment_id").transformWithStateInPandas(Verifier(key, forget_ms), OUTPUT, "Append", mode)

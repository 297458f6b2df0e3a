"""Explicit schemas of all sources; nothing is inferred."""

from __future__ import annotations

_strings = lambda names: ", ".join(f"{n} STRING" for n in names.split())

SDN = _strings("ent_num sdn_name sdn_type program title call_sign vess_type tonnage grt vess_flag vess_owner remarks")
ALT = _strings("ent_num alt_num alt_type alt_name alt_remarks")
ADD = _strings("ent_num add_num address city_state_zip_etc country add_remarks")
COMMENTS = _strings("ent_num remarks_text")
TARGETS = _strings("id schema name aliases birth_date countries addresses identifiers sanctions phones emails program_ids dataset first_seen last_seen last_change")
NODES = "nodeid INT, isFraud INT, init_balance DOUBLE, fraudStep INT"
TRANSACTIONS = _strings("sourceNodeId targetNodeId value time")
CLASSES = _strings("txId class")
EDGES = _strings("txId1 txId2")
N_FEATURES = 165


def features(n: int = N_FEATURES) -> str:
    return "txId STRING, time_step INT, " + ", ".join(f"f{i} DOUBLE" for i in range(1, n + 1))

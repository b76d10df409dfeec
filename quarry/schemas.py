"""Schemas and constants of the scoring engine."""

from __future__ import annotations

DIM = 14
#: Quantised values are floats times this, as whole numbers.
SCALE = 10_000
NEIGHBOURS = 5
#: A request is approved with fewer fraud labels than this among its neighbours.
REJECT_FROM = 3
#: Fast counts that are searched again exactly.
AMBIGUOUS = (2, 3)
NPROBE = 8
MAX_CLUSTERS = 4096
MAX_BODY_BYTES = 65_536
UINT32_MAX = 4_294_967_295

REQUEST = """id string,
 transaction struct<amount: float, installments: bigint, requested_at: string>,
 customer struct<avg_amount: float, tx_count_24h: bigint, known_merchants: array<string>>,
 merchant struct<id: string, mcc: string, avg_amount: float>,
 terminal struct<is_online: boolean, card_present: boolean, km_from_home: float>,
 last_transaction struct<timestamp: string, km_from_current: float>"""
REFERENCE = "vector array<float>, label string"

#: Risk of a merchant category; any other code has DEFAULT_RISK. Fixed values.
MCC_RISK = {
    "5411": 0.15,
    "5812": 0.30,
    "5912": 0.20,
    "5944": 0.45,
    "7801": 0.80,
    "7802": 0.75,
    "7995": 0.85,
    "4511": 0.35,
    "5311": 0.25,
    "5999": 0.50,
}
DEFAULT_RISK = 0.5

#: What a feature is divided by, as reciprocals in single precision are multiplied. Fixed values.
MAX_AMOUNT, MAX_INSTALLMENTS, AMOUNT_RATIO, MAX_MINUTES, MAX_KM, MAX_TX_24H, MAX_MERCHANT_AMOUNT = 10_000, 12, 10, 1440, 1000, 20, 10_000
MAX_HOUR, MAX_WEEKDAY = 23, 6

V = [f"v{i}" for i in range(DIM)]
Q = [f"q{i}" for i in range(DIM)]
LO = [f"lo{i}" for i in range(DIM)]
HI = [f"hi{i}" for i in range(DIM)]
C = [f"c{i}" for i in range(DIM)]

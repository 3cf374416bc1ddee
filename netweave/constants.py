"""Names, ids, weights and thresholds that results depend on."""

from __future__ import annotations

# --- Fixed values: traffic classes -------------------------------------
CLASSES = ["BENIGN", "DoS Hulk", "PortScan", "DDoS"]
LABEL_IDS = {"BENIGN": 0, "DoS Hulk": 1, "PortScan": 2, "DDoS": 3}
ATTACK_CLASSES = ["DoS Hulk", "PortScan", "DDoS"]
CLASS_WEIGHTS = {0: 1.0, 1: 9.84, 2: 14.31, 3: 17.74}

# --- Fixed values: flow assembly and alerting ---------------------------
FLOW_TIMEOUT_US = 5_000_000
DEDUP_WINDOW_US = 60_000_000
ALERT_THRESHOLD = 0.95
CRITICAL_CONFIDENCE = 0.95
CAPTURED_PROTOCOLS = ["TCP", "UDP", "ICMP"]
TCP_FLAG_BITS = {"fin": 0x01, "syn": 0x02, "rst": 0x04, "psh": 0x08, "ack": 0x10, "urg": 0x20}
EVICTION_COUNT = 100
DEFAULT_PAGE_SIZE = 50
MAX_PAGE_SIZE = 200
# period -> (hours looked back, bucket width in minutes)
TIMELINE_PERIODS = {"hour": (1, 5), "day": (24, 60), "week": (168, 1440)}

# --- Fixed values: the 25 model inputs, in model order -------------------
MODEL_FEATURES = [
    " Avg Fwd Segment Size",
    " Fwd Packet Length Mean",
    " Fwd Packet Length Max",
    " Subflow Fwd Bytes",
    "Total Length of Fwd Packets",
    " Packet Length Mean",
    " Average Packet Size",
    " Bwd Packet Length Mean",
    " Avg Bwd Segment Size",
    " Fwd IAT Mean",
    " Total Fwd Packets",
    "Subflow Fwd Packets",
    "Init_Win_bytes_forward",
    " PSH Flag Count",
    " Fwd Header Length",
    " Subflow Bwd Bytes",
    " Fwd IAT Std",
    " Destination Port",
    " Total Length of Bwd Packets",
    " Flow Duration",
    "Flow Bytes/s",
    " Bwd Header Length",
    " Flow IAT Std",
    " Init_Win_bytes_backward",
    " ACK Flag Count",
]

# --- Fixed values: feature selection -------------------------------------
CRITICAL_FEATURES = [
    " Flow Duration",
    "Flow Bytes/s",
    " Flow Packets/s",
    " SYN Flag Count",
    " ACK Flag Count",
]
METHOD_WEIGHTS = {
    "random_forest": 0.3,
    "xgboost": 0.4,
    "univariate": 0.15,
    "mutual_info": 0.15,
}
CORRELATION_LIMIT = 0.95
SELECTED_COUNT = 25
COMPARED_COUNT = 15

# --- Fixed values: column groups by name part ----------------------------
NAME_GROUPS = {
    "flow": ["Flow"],
    "forward": ["Fwd", "Forward"],
    "backward": ["Bwd", "Backward"],
    "packet": ["Packet"],
    "flag": ["PSH", "URG", "FIN", "SYN", "RST", "ACK"],
    "time": ["Time", "IAT"],
}

# --- Fixed values: features the literature names -------------------------
LITERATURE_FEATURES = [
    "Flow Duration",
    "Total Fwd Packets",
    "Total Backward Packets",
    "Flow Bytes/s",
    "Flow Packets/s",
    "Fwd Packet Length Mean",
    "Bwd Packet Length Mean",
    "Flow IAT Mean",
    "Fwd IAT Mean",
    "Bwd IAT Mean",
    "PSH Flag Count",
    "URG Flag Count",
    "FIN Flag Count",
    "SYN Flag Count",
    "RST Flag Count",
    "ACK Flag Count",
    "Average Packet Size",
    "Subflow Fwd Bytes",
    "Subflow Bwd Bytes",
    "Init_Win_bytes_forward",
]

# --- Fixed values: training -----------------------------------------------
TEST_SHARE = 0.2
VALIDATION_SHARE = 0.1
SPLIT_SEED = 42
SMOTE_NEIGHBOURS = 3
BOOSTING = {"max_depth": 6, "learning_rate": 0.1, "rounds": 200, "subsample": 0.8,
            "column_sample": 0.8, "gamma": 0.1, "alpha": 0.1, "ridge": 1.0, "patience": 10}
TUNING_GRID = {
    "n_estimators": [100, 200],
    "max_depth": [5, 7, 10],
    "learning_rate": [0.01, 0.1],
    "subsample": [0.8, 0.9],
    "colsample_bytree": [0.8, 0.9],
}
TUNING_FOLDS = 3
QUALITY_GATES = {"min_accuracy": 0.95, "min_f1_score": 0.90, "max_false_positive_rate": 0.05}

# --- Fixed values: automatic blocking --------------------------------------
AUTO_BLOCK_THRESHOLD = 10
AUTO_BLOCK_HOURS = 24

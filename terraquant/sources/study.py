"""Fixed values of the emission study the operators were designed around."""

from __future__ import annotations

# Selected model features, in model order.
CH4_FEATURES = [
    "Water_Temperature", "Depth", "TN_re", "Ratio_CN_inout", "NH4_re", "NH4_rl",
    "HRT", "NH4_in", "TN_in", "HLR", "COD_re", "COD_in",
]
N2O_FEATURES = ["TN_re", "CN_in", "NH4_re", "Depth", "NH4_in", "NO3_re", "TN_in", "NO3_in"]

# Discharge standards in report order, and conversion constants.
STANDARDS = ["Class I-A", "Class I-B", "Class II", "Class III"]
GWP_CH4 = 28.0
GWP_N2O = 273.0
WATER_VOLUME_M3_PER_YEAR = 67_828_164_300.0
DEFAULT_HLR_M3_M2_D = 0.2
N_SIMULATIONS = 10_000
CLIP_QUANTILES = (0.01, 0.99)
TEST_FRACTION = 0.3
COMPARISON_SEEDS = 50
COMPARISON_FOLDS = 5
SELECTION_TOP = 20
GRAPH_PERMUTATIONS = 500

# Held-out sample sizes, clip bounds and point predictions (log10 CH4, log10 N2O).
EXPECTED_TEST_ROWS = {"CH4": 72, "N2O": 87}
CLIP_BOUNDS = {"CH4": (0.10139953009676042, 5.40191725051757), "N2O": (0.08634453746471552, 4.263611784723947)}
POINT_PREDICTIONS = {
    "Class I-A": (2.392892360687256, 1.685372700549187),
    "Class I-B": (1.904382348060608, 1.573195643866429),
    "Class II": (2.187045097351074, 1.551201816479810),
    "Class III": (3.316656351089478, 1.544445423663422),
}

# Hyper-parameter grids of the comparison stage that the leaderboards run.
GRIDS = {
    "ridge": {"alpha": [0.01, 0.1, 1, 10, 50, 100]},
    "lasso": {"alpha": [0.0001, 0.001, 0.01, 0.1, 1, 10]},
    "knn": {"k": [3, 5, 7, 9, 11], "weights": ["uniform", "distance"], "p": [1, 2]},
}

# Directed graphs and their treatments.
GRAPHS = {
    "CH4_final": [
        ("COD_in", "TN_in"), ("COD_in", "CH4"), ("TN_in", "CH4"), ("HRT", "CH4"), ("Depth", "HRT"),
    ],
    "N2O_final": [
        ("TN_in", "CN_in"), ("TN_in", "N2O"), ("CN_in", "N2O"), ("Depth", "N2O"),
        ("NH4_in", "CN_in"), ("NH4_in", "TN_in"), ("NH4_in", "N2O"),
    ],
    "CH4_top3": [("COD_in", "CH4"), ("COD_in", "HRT"), ("HRT", "CH4"), ("Depth", "HRT")],
    "CH4_top4": [
        ("COD_in", "CH4"), ("COD_in", "TN_in"), ("HRT", "CH4"), ("TN_in", "NH4_re"),
        ("TN_in", "CH4"), ("NH4_re", "CH4"),
    ],
    "CH4_top5": [
        ("COD_in", "CH4"), ("COD_in", "HRT"), ("HRT", "CH4"), ("Depth", "HRT"),
        ("Water_Temperature", "CH4"), ("HLR", "HRT"),
    ],
    "N2O_top3": [("NH4_in", "CN_in"), ("NH4_in", "N2O"), ("CN_in", "N2O"), ("Depth", "N2O")],
    "N2O_top4": [
        ("TN_in", "CN_in"), ("TN_in", "N2O"), ("CN_in", "N2O"), ("Depth", "N2O"),
        ("NH4_in", "CN_in"), ("NH4_in", "TN_in"), ("NH4_in", "N2O"),
    ],
    "N2O_top5": [
        ("TN_in", "CN_in"), ("TN_in", "N2O"), ("CN_in", "N2O"), ("Depth", "N2O"),
        ("NH4_in", "CN_in"), ("NH4_in", "TN_in"), ("NH4_in", "N2O"),
        ("TN_in", "TN_re"), ("TN_re", "N2O"), ("Depth", "TN_re"),
    ],
}
# Nodes of a graph that no edge touches.
ISOLATED = {"CH4_top3": ["Water_Temperature"]}
CANDIDATE_GRAPHS = ["CH4_top3", "CH4_top4", "CH4_top5", "N2O_top3", "N2O_top4", "N2O_top5"]
TREATMENTS = {"CH4_final": ["TN_in", "COD_in", "HRT", "Depth"], "N2O_final": ["Depth", "CN_in", "TN_in", "NH4_in"]}

# Features highlighted in the driver charts.
FOCUS_FEATURES = {"CH4": ["TN_in", "COD_in"], "N2O": ["CN_in", "TN_in", "NH4_in"]}

# Province short name, official name, English label.
PROVINCES = [
    ("北京", "北京市", "Beijing"), ("天津", "天津市", "Tianjin"), ("河北", "河北省", "Hebei"),
    ("山西", "山西省", "Shanxi"), ("内蒙古", "内蒙古自治区", "Inner Mongolia"), ("辽宁", "辽宁省", "Liaoning"),
    ("吉林", "吉林省", "Jilin"), ("黑龙江", "黑龙江省", "Heilongjiang"), ("上海", "上海市", "Shanghai"),
    ("江苏", "江苏省", "Jiangsu"), ("浙江", "浙江省", "Zhejiang"), ("安徽", "安徽省", "Anhui"),
    ("福建", "福建省", "Fujian"), ("江西", "江西省", "Jiangxi"), ("山东", "山东省", "Shandong"),
    ("河南", "河南省", "Henan"), ("湖北", "湖北省", "Hubei"), ("湖南", "湖南省", "Hunan"),
    ("广东", "广东省", "Guangdong"), ("广西", "广西壮族自治区", "Guangxi"), ("海南", "海南省", "Hainan"),
    ("重庆", "重庆市", "Chongqing"), ("四川", "四川省", "Sichuan"), ("贵州", "贵州省", "Guizhou"),
    ("云南", "云南省", "Yunnan"), ("西藏", "西藏自治区", "Tibet"), ("陕西", "陕西省", "Shaanxi"),
    ("甘肃", "甘肃省", "Gansu"), ("青海", "青海省", "Qinghai"), ("宁夏", "宁夏回族自治区", "Ningxia"),
    ("新疆", "新疆维吾尔自治区", "Xinjiang"), ("香港", "香港特别行政区", "Hong Kong"),
    ("澳门", "澳门特别行政区", "Macau"), ("台湾", "台湾省", "Taiwan"),
]

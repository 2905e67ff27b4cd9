"""Dataset catalogue (S04): where a dataset's real, synthetic, train and
test tables live, its features and its label column."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class DatasetSpec:
    name: str
    real_dir: str
    fake_dir: str
    train_file: str
    test_files: dict[str, str]
    features: tuple[str, ...]
    label_col: str
    pca_cols: tuple[str, ...] = ()
    model_cols: tuple[str, ...] = ()
    synthetic_dirs: dict[str, str] = field(default_factory=dict)
    synthetic_files: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def train_path(self, root: str) -> str:
        return f"{root.rstrip('/')}/{self.real_dir}/{self.train_file}"

    def test_path(self, root: str, split: str) -> str:
        return f"{root.rstrip('/')}/{self.real_dir}/{self.test_files[split]}"

    def synthetic_candidates(self, root: str, mode: str) -> list[str]:
        d = self.synthetic_dirs[mode]
        return [f"{root.rstrip('/')}/{self.fake_dir}/{d}/{f}" for f in self.synthetic_files.get(mode, ())]


# The two session datasets, their files, features and labels.
SESSION_FEATURES = (
    "log_count_total_connect", "log_cs_byte", "log_transmit_speed_BPS", "log_count_connect_IP",
    "log_avg_count_connect", "log_time_taken", "log_time_interval_mean", "log_time_interval_var",
    "log_ratio_trans_receive",
)
SYNTHETIC_DIRS = {"wgan_gp": "wgan-gp", "llm": "LLM"}
DARPA99 = DatasetSpec(
    name="darpa99", real_dir="dataset-DARPA99", fake_dir="fake dataset-DARPA99",
    train_file="training dataset_week4_normalized.csv",
    test_files={"week13": "test dataset_week1-3_normalized.csv", "week5": "test dataset_week5_normalized.csv"},
    features=("log_time_interval_mean", "log_time_interval_var", "log_time_taken", "log_cs_byte",
              "log_ratio_trans_receive", "log_count_connect_IP", "log_count_total_connect",
              "log_avg_count_connect", "log_transmit_speed_BPS"),
    label_col="LABEL",
    pca_cols=("log_count_total_connect", "log_cs_byte", "log_transmit_speed_BPS", "log_count_connect_IP",
              "log_avg_count_connect"),
    model_cols=("PC", "log_ratio_trans_receive", "log_time_taken", "log_time_interval_mean", "log_time_interval_var"),
    synthetic_dirs=SYNTHETIC_DIRS,
    synthetic_files={"llm": ("llm_studio_ssh_1000.csv", "llm_studio_ssh_2000.csv", "synthetic_ssh.csv"),
                     "wgan_gp": ("synthetic_ssh.csv",)},
)
NB15 = DatasetSpec(
    name="nb15", real_dir="dataset-NB15", fake_dir="fake dataset-NB15",
    train_file="UNSW_NB15_new_training_log_normalized.csv",
    test_files={"test": "UNSW_NB15_new_testing_log_normalized.csv"},
    features=("log_mean_of_IPA_time", "log_ratio_trans_receive", "log_speed_transmit_connect", "log_dur",
              "log_sbytes", "log_ct_src_dport_ltm", "log_ct_dst_ltm", "log_ct_src_ltm"),
    label_col="new_label",
    model_cols=("log_mean_of_IPA_time", "log_ratio_trans_receive", "log_speed_transmit_connect", "log_dur",
                "log_sbytes", "log_ct_src_dport_ltm", "log_ct_dst_ltm", "log_ct_src_ltm"),
    synthetic_dirs=SYNTHETIC_DIRS,
    synthetic_files={"llm": ("llm_studio_ssh_1000.csv", "llm_studio_ssh_2000.csv", "synthetic_ssh.csv"),
                     "wgan_gp": ("synthetic_ssh.csv",)},
)
CATALOG = {s.name: s for s in (DARPA99, NB15)}


def catalog_frame(spark: SparkSession, specs: Sequence[DatasetSpec]) -> DataFrame:
    """The catalogue as a DataFrame: one row per (dataset, split)."""
    rows = []
    for s in specs:
        rows.append((s.name, "train", s.real_dir, s.train_file, len(s.features), s.label_col))
        for split, f in s.test_files.items():
            rows.append((s.name, split, s.real_dir, f, len(s.features), s.label_col))
    return spark.createDataFrame(rows, "dataset string, split string, dir string, file string, "
                                       "n_features int, label_col string")

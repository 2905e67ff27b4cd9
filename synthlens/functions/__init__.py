"""Column expressions: numeric rules (bins, draws, scaling) and reply text."""

from synthlens.functions.numeric import (bin_edge, finite_or_null, hist_bin, md5_normal, md5_unit,
                                         minmax_100, ratio, ratio_or_zero, to_double)
from synthlens.functions.text import (parse_replies, repair_cut, repaired, reply_clean, reply_slice, strip)

__all__ = [
    "bin_edge", "finite_or_null", "hist_bin", "md5_normal", "md5_unit", "minmax_100", "ratio",
    "ratio_or_zero", "to_double", "parse_replies", "repair_cut", "repaired", "reply_clean",
    "reply_slice", "strip",
]

"""The corpus operators' queries, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op3_bpe_tree
from .collocations import OP11_SQL, op11_collocations
from .licenses import OP13_SQL, op13_license_rules
from .lm import op4_log_bilinear
from .minhash import OP9_SQL, op9_superminhash
from .packing import instruction_packing, op1_packing
from .periodic import OP12_SQL, op12_periodic_runs
from .quality import op7_quality_trees
from .sharding import OP2_SQL, op2_size_tiered_shards
from .suffix import OP6_SQL, op6_suffix_arrays
from .toxicity import op8_toxic_neighbours
from .warc import OP5_SQL, op5_revisits
from .winnowing import op10_winnowing


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "instruction_packing": instruction_packing,
        "op2_size_tiered_shards": op2_size_tiered_shards,
        "op3_bpe_tree": op3_bpe_tree,
        "op4_log_bilinear": op4_log_bilinear,
        "op5_revisits": op5_revisits,
        "op6_suffix_arrays": op6_suffix_arrays,
        "op7_quality_trees": op7_quality_trees,
        "op8_toxic_neighbours": op8_toxic_neighbours,
        "op9_superminhash": op9_superminhash,
        "op10_winnowing": op10_winnowing,
        "op11_collocations": op11_collocations,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_license_rules": op13_license_rules,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_size_tiered_shards": OP2_SQL, "op5_revisits": OP5_SQL, "op6_suffix_arrays": OP6_SQL, "op9_superminhash": OP9_SQL, "op11_collocations": OP11_SQL, "op12_periodic_runs": OP12_SQL, "op13_license_rules": OP13_SQL}

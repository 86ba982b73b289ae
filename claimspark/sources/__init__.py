from claimspark.sources.adapter import claims_raw, speaker_history  # noqa: F401
from claimspark.sources.processed import (  # noqa: F401
    read_for_scoring,
    read_processed,
    write_processed,
    write_table,
)
from claimspark.sources.tables import read_table  # noqa: F401
from claimspark.sources.tsv import load_all_splits, load_split, null_out_na, write_splits_tsv  # noqa: F401

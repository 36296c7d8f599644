from cohortlens.functions.exprs import (  # noqa: F401
    clip_lower,
    cliff_label,
    cohens_label,
    label_from_text,
    log_loss,
    nan_to_null,
    round_doubles,
    safe_div,
)
from cohortlens.functions.hashing import h52, uniform  # noqa: F401

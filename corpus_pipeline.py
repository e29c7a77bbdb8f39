"""Documents to a training mixture. The stages are in cueweave.llm.pipeline."""

from cueweave.llm.pipeline import (  # noqa: F401
    LANGUAGE_MARGIN,
    LANGUAGE_SAMPLE,
    ORACLE_SQL,
    STAGES,
    drop_contaminated,
    drop_near_copies,
    drop_suffix_repeats,
    identify_language,
    mix_sources,
    run,
)

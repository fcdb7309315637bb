"""The registered queries and their SQL."""

from lociq.plans import bases, calling, cohort, extras, formats, matching, pathway, phasing, reads, realign, sequences, variants, variation

PARTS = (bases, calling, cohort, extras, formats, matching, pathway, phasing, reads, realign, sequences, variants, variation)
QUERIES = {name: query for part in PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in PARTS for name, sql in part.ORACLES.items()}

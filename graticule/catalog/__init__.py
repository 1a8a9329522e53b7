"""All registered queries."""
from graticule.catalog.registry import REGISTRY  # noqa: F401
from graticule.catalog import contracts, design, joins, maps, models, pairs, projections, resampling, sealing, sequences, spectra, summaries, surfaces  # noqa: F401

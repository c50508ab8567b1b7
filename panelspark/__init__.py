"""Evidence-aware panel, linkage and kin analytics as lazy Spark plans."""

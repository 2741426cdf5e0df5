"""Place records on Spark: normalisation, entity resolution, geo ranking, planning, views and exports."""

"""loam: corpus curation and a knowledge store on Spark DataFrames."""

"""quillmill: prompt compression, faithfulness checks and corpus reports as Spark DataFrames."""

"""rowlake: row operators, quality checks and corpus operators as lazy Spark plans."""

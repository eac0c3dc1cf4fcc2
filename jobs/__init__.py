"""Jobs with a command line: each module has run(spark, ...), which takes plain paths and a configuration."""

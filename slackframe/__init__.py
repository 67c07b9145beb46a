"""slackframe: iterative analytics over keyed vector state, expressed as Spark plans."""

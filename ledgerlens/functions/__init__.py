"""Column builders: cleaning, rules, text and vectors. No function here runs a job."""

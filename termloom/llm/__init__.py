"""Training-data operators. Nothing outside this folder imports it; ``llm.queries`` lists what it registers."""

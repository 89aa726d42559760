"""Language-model reasoning about windows and series: prompts, replies, back-ends."""

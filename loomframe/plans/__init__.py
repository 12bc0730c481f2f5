"""Physical layout: what to broadcast, how to split a large group, how to carry
state between the pieces. Operators call these; users rarely need to."""

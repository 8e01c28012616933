"""Column expressions: geography, vehicle physics, road tags."""

"""Multi-step plans and the helpers that keep them safe on large inputs."""

"""Engine, catalogue store and front end."""

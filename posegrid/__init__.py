"""posegrid: DataFrame operators for posed frames, point clouds, trajectories and evaluation tables."""

"""Line-oriented report writers."""
